"""Personal data: fixed finders, and identifiers discovered by their contexts.

What the finders see are seeds. The words around an identifier-like token, with or
without the token's make-up, are its patterns, of several lengths. Patterns are
scored by how much of what they hold is known, instances by the patterns they
stand in, in turns, so that what is discovered speaks for further patterns;
patterns that end with high confidence mark the tokens no finder knew.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import Shared, id_and_text, may_be_in

KINDS = ["email", "ip", "card", "phone", "secret"]
#: Of a token that has the form of a kind and fails its check: known to be nothing.
NOTHING = "none"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Keys by their published form, and long hexadecimal strings; only seeds, not base kinds.
_SECRET = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,})\b")
_DIGITS = re.compile(r"[0-9]+")
_ENDS = frozenset(" \t\n\r\x0b\x0c\"'`=:,;()<>[]{}|")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest run of local characters before it that no earlier
    match took, if a domain follows: what the leftmost search finds."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(twice[int(d)]) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of email, ip, card and phone in code points."""
    ips = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return [emails(text), ips, cards, phones]


def _make_up(token: str) -> str:
    """Which kinds of character."""
    return "".join(sorted({"d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c for c in token}))


def _plain(text: str) -> str:
    """Lower case, digits as 0, white space as one blank; long ones by digest."""
    text = re.sub(r"\s+", " ", _DIGITS.sub("0", text.lower()))
    return text if len(text) <= 80 else hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def _before(text: str, at: int) -> tuple[int, int]:
    """Where the word before ``at`` begins, and the word before that."""
    begin = []
    for _ in range(2):
        while at and text[at - 1] in _ENDS:
            at -= 1
        while at and text[at - 1] not in _ENDS:
            at -= 1
        begin.append(at)
    return begin[0], begin[1]


def _after(text: str, at: int) -> int:
    """Where the word after ``at`` ends."""
    for inside in (True, False):
        while at < len(text) and (text[at] in _ENDS) == inside:
            at += 1
    return at


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """Contexts of several lengths on both sides, with and without the make-up."""
    one, two = _before(text, start)
    after = _plain(text[end : _after(text, end)])
    near, far, kind = _plain(text[one:start]), _plain(text[two:start]), _make_up(text[start:end])
    return [f"{far}_{kind}", f"{far}_", f"{far}_|{after}", f"{near}_{kind}|{after}", f"{near}_{kind}", f"_{kind}|{after}"]


def mentions(text: str, base: list[list[tuple[int, int]]]) -> list[dict]:
    """Seeds and identifier-like tokens (six characters or more, two digits or
    more) that no seed overlaps, each with its patterns. Those of the form of an
    address or card that fail its check speak against their patterns."""
    seeds = sorted((a, b, k) for k, spans in zip(KINDS, base, strict=False) for a, b in spans)
    upto: list[int] = []  # the furthest end so far
    for _, b, _ in seeds:
        upto.append(max(b, upto[-1] if upto else 0))
    starts = [a for a, _, _ in seeds]
    for m in _SECRET.finditer(text):
        if m[0].startswith("AKIA") or not m[0].isdigit() and not m[0].isalpha():
            i = bisect_left(starts, m.end())
            if not i or upto[i - 1] <= m.start():
                seeds.append((*m.span(), "secret"))
    taken = sorted((a, b) for a, b, _ in seeds)
    out, i, end = [], 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        a, b = m.span()
        while a > end and text[a - 1] not in _ENDS:
            a -= 1
        while b < len(text) and text[b] not in _ENDS:
            b += 1
        end = b
        while b > a and text[b - 1] in ".!?":
            b -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        free = i == len(taken) or taken[i][0] >= b
        if free and b - a >= 6 and sum(map(str.isdigit, text[a:b])) >= 2:
            failed = _IP.fullmatch(text, a, b) or _CARD.fullmatch(text, a, b) and b - a >= 13
            out.append((a, b, NOTHING if failed else None))
    short = lambda x: x if len(x) <= 80 else hashlib.blake2b(x.encode(), digest_size=16).hexdigest()
    return [{"start": a, "end": b, "kind": k, "instance": short(text[a:b].lower()), "patterns": patterns_of(text, a, b)} for a, b, k in [*seeds, *out]]


_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_FIND_SCHEMA = (
    "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "found array<struct<start int, end int, kind string, instance string, patterns array<string>>>"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(_FOUND)]
    for b in batches:
        rows = []
        for x in b.column(1):
            text = x.as_py() or ""
            base = base_spans(text)
            joined = ",".join(f"{k}:{s}:{e}" for k, spans in zip(KINDS, base, strict=False) for s, e in spans)
            rows.append([*map(len, base), hashlib.sha256(joined.encode()).hexdigest(), joined, mentions(text, base)])
        cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base results and mentions of every whole text; no shuffle."""
    return id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(_find, _FIND_SCHEMA)


def _is_hidden(one_in: int) -> Column:
    return F.pmod(F.xxhash64("instance"), F.lit(one_in)) == 0


def confident_patterns(found: DataFrame, shared: Shared, rounds: int, least: float, hidden: int = 0) -> DataFrame:
    """(pattern, kind, p) after ``rounds`` turns of scoring over the graph of
    patterns and distinct instances. A pattern's confidence in a kind is the
    confidence of its instances in it, over the same plus that of other kinds, half
    of what is unknown, and one; an unknown instance's is that of one of its
    patterns being right. Patterns with too few instances ever to reach ``least``
    are left out at once. With ``hidden`` = h, one in h seeds is taken as unknown,
    to see whether its contexts find it."""
    each = found.select(F.explode("found").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    if hidden:
        each = each.withColumn("kind", F.when(~_is_hidden(hidden), F.col("kind")))
    each = each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    enough = each.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= math.ceil(least / (1 - least) - 1e-9))
    edges = shared.keep(each.join(enough, "pattern"))
    sizes = shared.keep(edges.select("pattern", "n").distinct())
    seeds = shared.keep(edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("p", F.lit(1.0)))
    known = seeds
    for turn in range(rounds):
        held = edges.select("pattern", "instance").join(known, "instance")
        sums = held.groupBy("pattern", "kind").agg(F.sum("p").alias("s"))
        every = held.groupBy("pattern").agg(F.sum("p").alias("all"))
        scores = sums.join(every, "pattern").join(sizes, "pattern")
        p = F.col("s") / (F.col("all") + (F.col("n") - F.col("all")) / 2 + 1)
        scored = shared.keep(scores.select("pattern", "kind", p.alias("p")).where("p > 0.05"))
        if turn + 1 < rounds:
            doubt = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9))))
            open_ = edges.where("kind is null").select("pattern", "instance").join(scored, "pattern")
            guessed = open_.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("p")).join(seeds.select("instance"), "instance", "left_anti")
            # an instance is of one kind, the likeliest
            guessed = guessed.groupBy("instance").agg(F.max(F.struct("p", "kind")).alias("best")).select("instance", "best.kind", "best.p")
            known = shared.keep(seeds.unionByName(guessed))
    best = scored.where((F.col("p") >= least) & (F.col("kind") != NOTHING)).groupBy("pattern").agg(F.max(F.struct("p", "kind")).alias("best"))
    return best.select("pattern", "best.kind", "best.p")


def _discovered(table: DataFrame, shared: Shared, rounds: int, least: float, keys: list[str]) -> DataFrame:
    """(``keys``, kind, start, end) of tokens that no finder knew."""
    patterns = shared.keep(confident_patterns(table, shared, rounds, least))
    each = table.select(*keys, F.explode("found").alias("m")).where("m.kind is null").select(*keys, "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    best = each.join(patterns, "pattern").groupBy(*keys, "start", "end").agg(F.max(F.struct("p", "kind")).alias("best"))
    return best.select(*keys, "best.kind", "start", "end")


def scan_pii(docs: DataFrame, rounds: int = 3, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and pieces.

    The counts are of base spans. ``spans`` has the base spans, the secrets found
    by their published forms and the discovered ones, as kind:start:end in the
    order of KINDS, then start; ``pieces`` the same as structs. A null text is
    empty. Every row is kept, also equal ones; ids may repeat or be null. A text is
    read whole, in time that grows with its length. A pattern needs the evidence of
    four seeds at ``least`` = 0.8; ties go to the kind that comes last by name.
    """
    shared = Shared(docs.sparkSession)
    table = shared.keep(find(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    seen = table.select("row", F.explode("found").alias("m")).select("row", "m.kind", "m.start", "m.end").where(F.col("kind").isin(KINDS))
    spans = seen.unionByName(_discovered(table, shared, rounds, least, ["row"]))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(order.alias("k"), "start", "end", "kind"))).alias("pieces"))
    text_of = F.transform("pieces", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    out = table.select("row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").join(lists, "row", "left").drop("row")
    return out.withColumn("spans", F.coalesce(F.array_join(text_of, ","), F.lit("")))


def found_again(docs: DataFrame, hidden: int = 5, rounds: int = 3, least: float = 0.8) -> DataFrame:
    """(kind, n_hidden, n_found, n_right): one in ``hidden`` distinct seeds is hidden
    from the scoring. How many there are, how many of them the patterns find, and
    how many of these under their own kind; kind null: tokens no finder knows."""
    shared = Shared(docs.sparkSession)
    table = shared.keep(find(docs))
    patterns = shared.keep(confident_patterns(table, shared, rounds, least, hidden))
    each = table.select(F.explode("found").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    each = each.where(_is_hidden(hidden) & (F.col("kind") != NOTHING) | F.col("kind").isNull())
    got = each.join(patterns.withColumnRenamed("kind", "guess"), "pattern", "left").groupBy("instance").agg(F.max("kind").alias("kind"), F.max(F.struct("p", "guess"))["guess"].alias("guess"))
    return got.groupBy("kind").agg(F.count(F.lit(1)).alias("n_hidden"), F.count("guess").alias("n_found"), F.count_if(F.col("guess") == F.col("kind")).alias("n_right"))


def masked(docs: DataFrame, rounds: int = 3, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in angle brackets;
    all other columns and all rows as they are. What the finders know is found
    again in the row itself; discovered spans depend on the text alone, so they go
    to every row of that text, whatever its id, and only such rows are shuffled.
    Null texts stay null."""
    shared = Shared(docs.sparkSession)
    table = shared.keep(find(docs, id_col, text_col).select("text_hash", "found"))
    new = _discovered(table, shared, rounds, least, ["text_hash"])
    new = shared.keep(new.groupBy(F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("start", "end", "kind")).alias("_new")))
    shared.only(new)
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, more in zip(b.column(place), b.column(b.num_columns - 1), strict=True):
                text = text.as_py()
                if text:
                    found = mentions(text, base_spans(text))
                    own = {(m["start"], m["end"]) for m in found if not m["kind"]}
                    text = mask(text, [m for m in found if m["kind"] in KINDS] + [m for m in more.as_py() or [] if (m["start"], m["end"]) in own])
                texts.append(text)
            cols = list(b.columns[:-1])
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    text_hash = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    some, rest = may_be_in(docs, text_hash, new, F.col("_hash"))
    some = some.join(new, text_hash == F.col("_hash"), "left").drop("_hash")
    none = F.lit(None).cast(new.schema["_new"].dataType).alias("_new")
    return some.unionByName(rest.select("*", none)).mapInArrow(cut, docs.schema)


def mask(text: str, spans: list[dict]) -> str:
    out, end = [], 0
    for p in sorted(spans, key=lambda p: (p["start"], -p["end"])):
        if p["start"] >= end:
            out += [text[end : p["start"]], f"<{p['kind']}>"]
        end = max(end, p["end"])
    return "".join([*out, text[end:]])
