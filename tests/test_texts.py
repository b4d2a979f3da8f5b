r"""Document sources: unions, macros, entries and their rejects."""

from tomewright.sources.texts import entries, learned, read_sources, sources_of, with_macros


def test_sources(spark, tmp_path):
    (tmp_path / "a.tex").write_text(r"intro \spell{One} body \x \spell{Two}" + "\n\n" + r"\spells \spell{} lost \spell{Three} \skip no \spell broken")
    (tmp_path / "b.tex").write_text(r"\spell{Four} costs $5\y")
    (tmp_path / "m1.tex").write_text(r"\newcommand{\x}{X \y}\newcommand{\y}{old}")
    (tmp_path / "m2.tex").write_text(r"\renewcommand*{\y}{\$ new}\newcommand{\z}[1]{#1}")
    at = lambda *names: [str(tmp_path / n) for n in names]
    files = spark.createDataFrame([("A", at("a.tex")), ("macros", at("m1.tex", "m2.tex")), ("A", at("a.tex"))], "book string, files array<string>")
    manifest = spark.createDataFrame([("A", at("a.tex")), ("B", at("b.tex", "a.tex"))], "book string, files array<string>")
    sources = sources_of(files, manifest)
    assert sources.count() == 5 and sources_of(files).count() == 3
    documents, macro_files = read_sources(spark, sources)
    assert documents.count() == 3 and macro_files.count() == 2
    macros = learned(macro_files)
    assert {(r.name, r.body) for r in macros.collect()} == {("x", r"X \y"), ("y", r"\$ new")}
    good, bad = entries(with_macros(documents, macros), "spell", silent="skip")
    got = {(r.book, r["name"], r.body) for r in good.collect()}
    a = {("One", r"body X \$ new"), ("Two", r"\spells")}
    assert got == {(b, *e) for b in "AB" for e in a} | {("B", "Four", r"costs $5\$ new")}
    assert sorted((r.book, r.reason) for r in bad.collect()) == [("A", "no name"), ("A", "no name"), ("B", "no name"), ("B", "no name")]
    none, _ = read_sources(spark, sources.limit(0))
    assert none.count() == 0 and with_macros(documents, macros.limit(0)).count() == 3
