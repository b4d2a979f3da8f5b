"""The markup queries over texts with all marks, against plain Python."""

import re

import pytest

import __spark_entry__

TEXTS = [
    "caf\u00e9 \u00a0\u00ff <b>&'\"</b> \u0100 \U0001f600",
    "plain words",
    "a *b* __c__ **d** _e_ \\* [x](y) f*",
    "# Head *x*\n---\n* one\n- two\n2. three\nhalf-way  \n\n1.5 [l](u)\n####### seven",
    "\\emph{a}  b % gone\n50\\% of $x$ \\{y\\}\tz",
    "",
    None,
]


def encoded(text):
    named = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
    return "".join(named.get(c) or (f"&#{ord(c)};" if 0xA0 <= ord(c) <= 0xFF else c) for c in text)


def inline(text):
    text = re.sub(r"\[([^\]\[]*)\]\([^()]*\)", r"\1", text)
    for mark, tag in (("**", "strong"), ("__", "strong"), ("*", "em"), ("_", "em")):
        quoted = re.escape(mark)
        text = re.sub(rf"{quoted}(.+?){quoted}", rf"<{tag}>\1</{tag}>", text)
    return re.sub(r"\\([\\*_\[\]()#!-])", r"\1", text)


def lines(text):
    out = []
    for x in text.split("\n"):
        head, item = re.match(r"(#{1,6}) +(.*)$", x), re.match(r"[ \t]*(?:[*-]|[1-9][0-9]*\.) +(.*)$", x)
        if not x.strip(" "):
            continue
        if re.match(r"-{3,}[ \t]*$", x):
            out.append("<hr/>")
        elif head:
            n = len(head[1])
            out.append(f"<h{n}>{inline(head[2].strip(' '))}</h{n}>")
        elif item and item[1]:
            out.append(f"<ul><li>{inline(item[1])}</li></ul>")
        else:
            out.append(f"<p>{inline(x.strip(' '))}{'<br/>' if x.endswith('  ') else ''}</p>")
    return "".join(out)


def plain(text):
    out, i = [], 0
    text = "\n".join(re.sub(r"(?<!\\)%.*", "", x) for x in text.split("\n"))
    while i < len(text):
        if m := re.compile(r"\\[A-Za-z0-9]+[ \t]*").match(text, i):
            i = m.end()
        elif text[i] == "\\" and text[i + 1 : i + 2] in set("{}%&$#_"):
            out.append("" if text[i + 1] in "{}$" else text[i + 1])
            i += 2
        else:
            out.append("" if text[i] in "{}$" else text[i])
            i += 1
    return re.sub(r"[ \t]+", " ", "".join(out)).replace("\n", "")


@pytest.mark.parametrize(
    ("name", "brute"), [("html_encoded", encoded), ("markdown_inlines", inline), ("markdown_html", lines), ("latex_plain_text", plain)]
)
def test_every_text_has_a_row(spark, tmp_path, name, brute):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert {r[0]: r[1] for r in rows} == {i: None if t is None else brute(t) for i, t in enumerate(TEXTS)}
    assert len(rows) == len(TEXTS)
