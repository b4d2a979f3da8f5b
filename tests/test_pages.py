"""Entry pages, good ones and each kind of reject."""

from tomewright.operators.pages import entry_pages
from tomewright.queries.documents import wiki_pages

SF_DIR = "/root/testdata/sf0.001"

GOOD = {
    "source": "<p>Source: Big Book / other</p>", "level": "<p><em>3rd-level evocation (ritual)</em></p>",
    "lines": "<p><strong>Casting Time:</strong> 1 reaction, when hit<br />\n<strong>Range:</strong> Self (30 feet)<br/><strong>Components:</strong> V, M (a &amp; b)<br><b>Duration:</b> Concentration, up to 1 hour</p>",
    "text": "<p>First <b>text</b>.</p>\n<ul><li>x</li></ul>", "more": "<p><strong><em>At Higher Levels.</em></strong> More.</p><p>Still.</p>", "classes": "<p><strong>Spell Lists.</strong> Bard, Wizard</p>", "table": "<table><tr><td>1</td></tr></table>",
}


def page(**changed):
    return '<html><div id="page-content">\n<div>nav</div>' + "\n".join((GOOD | changed).values()) + "\n<div>end</div>\n</div></html>"


def test_entry_pages(spark):
    bad = {
        "bad page-content makeup": page(source="<ul>x</ul>"), "bad source format": page(source="<p>Sauce: x</p>"), "bad level": page(level="<p>third-level cooking</p>"),
        "expected 4 lines": page(lines="<p>one<br/>two</p>"), "bad range format": page(lines=GOOD["lines"].replace("Range:", "Reach:")), "bad duration format": page(lines=GOOD["lines"].replace(" Concentration, up to 1 hour", " ")),
        "bad components": page(lines=GOOD["lines"].replace("V, M", "V, V")), "bad duration": page(lines=GOOD["lines"].replace(", up to 1 hour", "")), "expected class list": page(classes="<p>none</p>"),
        "empty description": page(text=""), "bad upcast format": page(more="<p>At higher levels, more</p>"),
    }
    plain = page(more="", table="", level="<p>Illusion cantrip</p>", lines=GOOD["lines"].replace(", when hit", "").replace("V, M (a &amp; b)", "S"))
    rows = [("good", page()), ("plain", plain), ("nothing", ""), ("null", None), *bad.items()]
    entries, rejects = entry_pages(spark.createDataFrame(rows, "page_id string, html string"))
    got = {r.page_id: r for r in entries.collect()}
    assert set(got) == {"good", "plain"}
    a, b = got["good"], got["plain"]
    assert (a.book, a.level, a.school, a.ritual, a.casting_time, a.reaction, a.range) == ("Big Book", 3, "evocation", True, "1 reaction", "when hit", "Self")
    assert (a.verbal, a.somatic, a.materials, a.concentration, a.duration, a.classes) == (True, False, "a & b", True, "1 hour", ["Bard", "Wizard"])
    assert a.description == "<p>First <b>text</b>.</p>\n<ul><li>x</li></ul>" and a.upcast == "<p>More.</p>\n<p>Still.</p>" and a.stat_block == GOOD["table"]
    assert (b.level, b.school, b.reaction, b.upcast, b.stat_block, b.somatic, b.materials) == (0, "illusion", None, None, None, True, None)
    reasons = {r.page_id: r.reason for r in rejects.collect()}
    assert reasons == {**{k: k for k in bad}, "nothing": "bad page-content makeup", "null": "bad page-content makeup"}


def test_pages_of_a_small_file_are_spread(spark):
    assert wiki_pages(spark, SF_DIR).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
