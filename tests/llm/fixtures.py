"""Small inputs with every awkward case, and brute-force versions."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = "doc_id long, text string, name long, key string, row string, spans string, n string, sid string, size string, part string, found string, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "in", "er", "an", "re", "on", "at", "en", "nd", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(20, 150)) for _ in range(40)]
    texts += [None, "", " ", "\n\t ", "one", "one two", "ONE two", "ééé öö " * 30, texts[0], texts[0], texts[0] + " end", "x" * 700, "Thon " * 300]
    for i in range(1, 12):  # near copies of one long text
        w = texts[7].split()
        w[i] = "changed"
        texts.append(" ".join(w))
    passage = words(rng, 60)
    texts += [f"{words(rng, 30)} {passage} {words(rng, 25)}" for _ in range(6)]
    texts.append(" ".join(words(rng, 3000) for _ in range(3)))
    texts.append(texts[-1][5000:9000] + " " + words(rng, 10))
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def repeats(docs, length=100):
    seen, out = set(), {}
    for i, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(docs, n, percent):
    """(size, smallest id reachable) of each document, from all pairs."""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def base_pii(text):
    text = text or ""
    luhn = lambda d: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    finders = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in finders.items()}
