"""Plain versions of the operators, and the rows that every operator must take."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

#: Extra columns whose names the operators use inside.
CLASHES = (
    "text_key", "kept", "run", "gid", "n", "place", "score", "copies", "rank", "h", "__bucket", "__id",
    "__key", "__n", "__text_key", "salt", "words", "item", "part_of", "print", "shard", "member", "cluster",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHES
)


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(400)) for _ in range(n)]


def long_text(seed=1, n=4000):
    return " ".join(words(n, seed))


def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, null ids."""
    base = words(120, 7)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:40], *words(80, 9)]
    texts = [
        (1, "One  two\tthree"), (2, "One two three"), (3, None), (4, ""), (5, " \n "),
        (6, "one two three"), (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(far)),
        (10, long_text()), (11, long_text()), (12, long_text() + " tail"),
        (13, "word " * 300), (14, "x"), (15, "Ünï çødé ☃ words, with Ümlauts"), (15, "other text"),
        (16, "!!! 123 ... "), (17, " ".join(base)), (17, " ".join(base)),
        (None, "no id at all"), (None, None), (None, "One two three"),
        (20, " ".join(words(40, 77))), (20, " ".join(words(40, 77))),
        (18, "line one\nline two\n" * 30), (19, " ".join(words(30, 3)) + " " + " ".join(base[:40])),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang = [None, "en", "fr"][i % 3]
        source = [None, "web", "books", "Ωμέγα", "a"][i % 5]
        out.append((doc_id, text, lang, source, None if i % 4 == 0 else i, *[f"c{i}"] * len(CLASHES)))
    return out


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def exact(rows):
    """(doc_id, keep_id, group_size, kept, sha256) of (doc_id, text) rows."""
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), p in zip(rows, plain, strict=True):
        groups[p].append(i)
    out = []
    for (i, _), p in zip(rows, plain, strict=True):
        keep = min((g for g in groups[p] if g is not None), default=None)
        out.append((i, keep, len(groups[p]), i == keep, sha(p)))
    return out


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def contaminated(rows, items, span=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    where = defaultdict(set)
    for item, text in items:
        w = word.findall(lowered(text))
        for s in range(max(1, len(w) - span + 1) if w else 0):
            where[tuple(w[s : s + span])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = word.findall(lowered(text)), set(), set()
        for s in range(len(w)):
            for n in {len(k) for k in where}:
                k = tuple(w[s : s + n])
                if len(k) == n and k in where:
                    hit |= set(range(s, s + n))
                    found |= where[k]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def similar(rows, percent=80):
    """(doc_id, n_shingles, component_id)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]) and both:
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        out.append((doc_id, len(sets[i]), min((m for m in members if m is not None), default=None)))
    return out


def repeats(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of rows in the order of documents."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        doc_id, text = rows[i]
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            at = (doc_id, text, s)
            if seen.setdefault(data[s : s + length], at) != at:
                gone[s : s + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), runs, sha(kept)))
    return out


def merkle(rows, run=3):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows
    (doc_id, text, lang, source, n_chars); texts of even CRC-32 lose their line ends."""
    import zlib

    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha(told(r[0]) + told(r[3]) + told(r[2]) + told(r[4]) + told(text))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + run])) for i in range(0, len(out[-1]), run)])
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = levels([leaf(r, r[1]) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h, proof = leaf(r, text), ""
            for tree, j in ((trees[s], i), (top, at)):
                for level in tree[:-1]:
                    near, k = level[j // run * run : j // run * run + run], j % run
                    proof += "".join(near[:k] + near[k + 1 :])
                    h = sha("".join([*near[:k], h, *near[k + 1 :]]))
                    j //= run
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]))
    return out


def simhash(text, n=4):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def close_components(prints, bits=4):
    """The smallest position that each fingerprint reaches by links."""
    least = list(range(len(prints)))
    todo, seen = [], set()
    for i in range(len(prints)):
        if i in seen:
            continue
        todo, group = [i], []
        seen.add(i)
        while todo:
            x = todo.pop()
            group.append(x)
            for j in range(len(prints)):
                if j not in seen and (prints[x] ^ prints[j]).bit_count() <= bits:
                    seen.add(j)
                    todo.append(j)
        for x in group:
            least[x] = min(group)
    return least
