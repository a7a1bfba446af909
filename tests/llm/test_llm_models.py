"""Language ID, secrets, token counts, WARC, toxicity and mixing."""

import gzip
import hashlib
import itertools
import random

import plain as P
import public_tokenizers
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from eventlens.llm import queries as Q
from eventlens.llm import token_counts as tokens
from eventlens.llm.language_id import fit_language_id, identify_languages
from eventlens.llm.mixing import mix_sources, source_targets
from eventlens.llm.secrets import (
    dictionary,
    fit_secret_filter,
    rule_labels,
    scan_secrets,
    secret_features,
)
from eventlens.llm.toxicity import (
    ToxicityModel,
    fit_characters,
    fit_toxicity,
    restore,
    restore_texts,
    restored_text,
    score_toxicity,
    words_of,
)
from eventlens.llm.warc import read_warc, salvage_members, salvage_plain, warc_records, write_warc

SF_001 = SF_DIR.replace("sf0.001", "sf0.01")
N = len(P.edge_rows())


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- language ID


def test_languages_of_held_out_documents(spark):
    out = Q.op1_language_id(spark, SF_001)
    docs = spark.read.parquet(f"{SF_001}/documents.parquet").select("doc_id", "lang")
    share = out.filter("held_out").join(docs, "doc_id").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")
    ).first()
    assert out.count() == docs.count()
    assert share[0] > 0.95 and 0 <= share[1] <= share[2] <= 1


def test_languages_of_edge_rows(spark):
    docs = P.edge_docs(spark)
    net = fit_language_id(docs)
    assert net.labels == ["en", "fr"]
    out = identify_languages(docs, net)
    assert out.count() == N
    rows = {(r.doc_id, r.lang_pred, r.score) for r in out.collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (16, "und", 0.0), (None, "und", 0.0)} <= rows
    assert all(r[1] in ("en", "fr", "und") for r in rows)
    assert identify_languages(P.no_docs(spark), net).count() == 0
    assert fit_language_id(P.no_docs(spark)) is None
    assert got(identify_languages(docs, None).select("lang_pred").distinct(), "*") == [("und",)]


def test_training_windows_come_from_whole_texts(spark, monkeypatch):
    from eventlens.llm import language_id as L

    seen = []
    monkeypatch.setattr(L, "train", lambda texts, labels: seen.extend(zip(labels, texts, strict=True)))
    rows = [(f"licence {i} " + "head " * 2000 + "fin " * 20000, "fi") for i in range(30)] + [("kort", "sv")]
    fit_language_id(spark.createDataFrame(rows, "text string, lang string"))
    assert ("sv", b"kort") in seen and len(seen) == 61
    assert sum(b"fin" in t for _, t in seen) > 40 and all(len(t) <= L.WINDOW for _, t in seen)


def test_windows_cover_texts():
    import numpy as np

    from eventlens.llm.language_id import WINDOW, cut_windows

    for n in (0, 1, 3, 255, 256, 257, 509, 510, 2000):
        data = np.arange(n) % 250 + 1
        windows, rows = cut_windows(data.astype(np.uint8), np.array([0, n]))
        assert windows.shape == (len(rows), WINDOW)
        seen = {tuple(w[i : i + 4]) for w in windows for i in range(WINDOW - 3)}
        assert all(tuple(data[i : i + 4]) in seen for i in range(n - 3))


# --- secrets


def test_secrets(spark):
    rng = random.Random(4)
    rows, secret = [], []
    for i in range(400):
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        number = str(rng.randrange(10**15, 10**16))
        kind = i % 5
        rows.append((i, ["use " + key + " here", f'token = "{hexa}" now', f"write to user{i}.name@mail7.example.com please", f"card {number} paid", f"password={hexa[:18]} kept"][kind]))
        secret.append(kind in (0, 1, 4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rule_labels(secret_features(docs))
    learned = fit_secret_filter(found.filter("doc_id % 4 <> 2"))
    out = {r.doc_id: r for r in scan_secrets(found, learned).collect()}
    assert len(out) == 400
    assert all(out[i].is_secret == s for i, s in enumerate(secret) if i % 4 == 2)
    assert out[1].value == rows[1][1].split('"')[1] and out[1].place == 3
    edge = secret_features(P.edge_docs(spark))
    assert scan_secrets(rule_labels(edge), learned).count() == edge.count()
    assert secret_features(P.no_docs(spark)).count() == 0
    none = fit_secret_filter(rule_labels(secret_features(P.no_docs(spark))))
    assert none.forest is None
    assert scan_secrets(found, none).filter("is_secret").count() == 400


def planted_findings(seed=8, n=900):
    """Texts with one value each, and whether it is a secret: the rules label few of them."""
    rng = random.Random(seed)
    token = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    mixed, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    filler = "please look at this text about garden water summer letter window silver market".split()
    out = []
    for i in range(n):
        words = rng.sample(filler, 6)
        kind = i % 6
        value = [
            token(mixed, rng.randrange(20, 44)), token(hexa, 32), token(mixed, 12) + "/" + token(mixed, 14) + "+7",
            f"/srv/{words[0]}/{words[1]}_{rng.randrange(99)}/file{i}.txt", f"{words[0]}-{words[1]}-{words[2]}-v{rng.randrange(99)}",
            "".join(w.capitalize() for w in words[:3]) + str(rng.randrange(10**5)),
        ][kind]
        before = rng.choice(["key", "credential", "with", "set"]) if kind < 3 else rng.choice(["see", "file", "with", "set"])
        out.append((i, " ".join([*words[:3], before, value, *words[3:]]), int(kind < 3)))
    return out


def test_the_forest_learns_more_than_the_rules(spark):
    """Held-out precision and recall on planted labels, most of which no rule gives."""
    rows = planted_findings()
    docs = spark.createDataFrame(rows, "doc_id long, text string, planted int")
    found = rule_labels(secret_features(docs)).drop("label").join(docs.select("doc_id", F.col("planted").alias("label")), "doc_id")
    ruled = rule_labels(found.drop("label")).filter("label is not null").count()
    learned = fit_secret_filter(found.filter("doc_id % 3 <> 1"))
    held = scan_secrets(found, learned).filter("doc_id % 3 = 1 and length >= 12").collect()
    hits = sum(r.is_secret and r.label for r in held)
    assert len(held) >= 280 and ruled < 0.5 * found.count()
    assert hits >= 0.95 * sum(r.label for r in held)
    assert hits >= 0.95 * sum(r.is_secret for r in held)


def test_copies_of_a_text_make_no_dictionary(spark):
    plain = [(i, " ".join(P.words(12, i)) + f" garden number {i}") for i in range(100)]
    for copies in (1, 30):
        texts = [*plain, *[(1000 + i, "the password is correcthorsebattery ok") for i in range(copies)]]
        found = rule_labels(secret_features(spark.createDataFrame(texts, "doc_id long, text string")))
        rows = {(r.value, r.dictionary_coverage, r.label) for r in found.filter("doc_id >= 1000").collect()}
        assert rows == {("correcthorsebattery", 0.0, None)}
        assert [r[0] for r in dictionary(spark.createDataFrame(texts, "doc_id long, text string")).filter("run = 'garden'").collect()] == ["garden"]


def test_values_beside_secret_words_are_candidates(spark):
    texts = {
        "pwd: hunter2": "hunter2", 'x secret = "Tr0ub4dor&3" y': "Tr0ub4dor&3", 'password = "correct-horse-battery-staple"': "correct-horse-battery-staple",
        "token abcdefghijklmnopqrstuvwxyzabcdef": "abcdefghijklmnopqrstuvwxyzabcdef", "my password is swordfish": "swordfish",
        "run --password=x1 now": "x1", "db_password=abc": "abc", '{"api_key": "k"}': "k", "PASSWD:$$$": "$$$", "auth := q": "q",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.value) for r in rule_labels(secret_features(docs)).collect()}
    assert {(i, value) for i, value in enumerate(texts.values())} <= found
    plain = spark.createDataFrame([(1, "the authors kept a short tokenizer, nothing else"), (2, "password=x1 kept")], "doc_id long, text string")
    assert got(secret_features(plain), "doc_id", "value") == [(2, "x1")]


# --- token counts


def all_cuts(text, pieces, unknown):
    """Best score and fewest pieces over every segmentation."""
    best = None
    for cut in itertools.product((0, 1), repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate(cut, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        score = n = 0
        for p in parts:
            if p in pieces:
                score, n = score + pieces[p], n + 1
            elif len(p) == 1:
                score, n = score + len(p.encode()) * unknown, n + len(p.encode())
            else:
                break
        else:
            if best is None or (-score, n) < best:
                best = (-score, n)
    return best[1]


def test_trie_counts_are_those_of_all_segmentations():
    rng = random.Random(1)
    letters = "abé" + tokens.MARK
    pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): -float(rng.randrange(1, 30)) for _ in range(60)}
    pieces.pop("é", None)
    trie = tokens.PieceTrie(pieces)
    for _ in range(300):
        word = "".join(rng.choice("abé☃") for _ in range(rng.randrange(1, 9)))
        assert trie.insert(word.encode()) == all_cuts(tokens.MARK + word, pieces, trie.unknown)
    assert len(trie) < 300 * 8


def test_long_pre_tokens_have_no_nodes(monkeypatch):
    rng = random.Random(2)
    pieces = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))): -rng.random() for _ in range(50)}
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    short = tokens.PieceTrie(pieces)
    want = [short.insert(w.encode()) for w in words]
    monkeypatch.setattr(tokens, "LONG_TOKEN", 10)
    trie = tokens.PieceTrie(pieces)
    assert [trie.insert(w.encode()) for w in words] == want
    assert len(trie) <= sum(len(w) + 1 for w in words if len(w) < 10) + 1


def test_token_counts_of_parts_of_a_text(spark, monkeypatch):
    texts = ["ab " * 50, "  a\tb\x0bab\n", "a" * 5000 + " b", " ", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = {"a": -1.0, "b": -1.0, "ab": -1.5, tokens.MARK: -1.0}
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 7)
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 3)
    out = got(tokens.count_tokens(docs, pieces), "doc_id", "n_pretokens", "n_tokens")
    assert out == [(0, 50, 100), (1, 3, 6), (2, 2, 5003), (3, 0, 0), (4, 1, 2)]


def test_a_long_pre_token_takes_bounded_memory():
    import tracemalloc

    trie = tokens.PieceTrie({"a": -1.0, "aa": -1.5, tokens.MARK: -1.0})
    word = b"a" * 300_001
    tracemalloc.start()
    assert trie.insert(word) == 150_002
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_token_counts_match_a_unigram_library(spark, monkeypatch):
    from tokenizers import Tokenizer, models

    pieces = tokens.unigram_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    unknown = tokens.PieceTrie(pieces).unknown
    library = Tokenizer(models.Unigram([("<unk>", unknown), *pieces.items()], 0, False))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    texts = dict(docs.filter("doc_id < 40").collect())
    monkeypatch.setattr(tokens, "TRIE_NODES", 200)
    out = {r.doc_id: r for r in tokens.count_tokens(docs, pieces).collect()}
    for i, text in texts.items():
        words = text.split()
        plain = [w for w in words if all(c in pieces for c in w)]
        trie = tokens.PieceTrie(pieces)
        for w in plain[:50]:
            ids = library.encode(tokens.MARK + w).ids
            assert trie.insert(w.encode()) == len(ids), w
        assert out[i].n_pretokens == len(words)
        assert out[i].n_tokens == sum(trie.insert(w.encode()) for w in words)


def test_token_counts_of_edge_rows(spark):
    out = tokens.count_tokens(P.edge_docs(spark), {"a": -1.0, tokens.MARK: -1.0})
    rows = got(out, "doc_id", "n_pretokens", "n_tokens")
    assert len(rows) == N
    assert {(3, 0, 0), (4, 0, 0), (5, 0, 0), (14, 1, 2)} <= set(rows)
    assert tokens.count_tokens(P.no_docs(spark), {}).count() == 0


# --- WARC


def pages(spark):
    big, other = "x" * 1500, "é" * 500
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", "small"), (4, "u", "small"), (5, "u", None),
            (6, "u", ""), (7, "u", other), (8, "u", other), (8, "u", other), (None, "u", big),
            (None, None, None), (9, "u", "WARC/1.1\r\nWARC-Type: fake\r\n\r\n\r\n" * 40)]
    rows = [(*r, "clash", "clash") for r in rows]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string, n string")


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    out = got(Q.op8_warc_salvage(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        top = max((r[0] or -1) for r in rows if (r[2] or "") == (html or ""))
        response = len(data) < 1000 or i == top or sum((r[2] or "") == (html or "") for r in rows) == 1
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else top))
    assert out == sorted(want, key=repr)
    df.filter("page_id > 100").write.parquet(str(tmp_path / "none/pages.parquet"))
    assert Q.op8_warc_salvage(spark, str(tmp_path / "none")).count() == 0


def archive(spark, tmp_path):
    _, df = pages(spark)
    path = tmp_path / "warc"
    write_warc(warc_records(df.coalesce(1)), str(path))
    (file,) = path.glob("file=0/part-*")
    return file.read_bytes()


def test_files_are_sized_by_bytes(spark, tmp_path):
    sizes = [10, 3000, 10, 400, 400, 400, 5000, 10]
    rows = [(i, f"u{i}", chr(97 + i) * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_warc(warc_records(df).coalesce(1), str(tmp_path / "warc"), file_bytes=4000)
    files = [f.stat().st_size for f in (tmp_path / "warc").glob("file=*/part-*")]
    assert 3 <= len(files) <= 5
    assert sum(n > 4000 for n in files) == 1 and max(files) < 5000 + 600
    out = read_warc(spark, str(tmp_path / "warc"))
    assert got(out, "kind", "payload_bytes") == sorted((("record", n) for n in sizes), key=repr)


def test_versions_of_archives():
    for version in (b"0.17", b"0.18", b"1.0", b"1.1"):
        record = b"WARC/" + version + b"\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
        assert [(e["kind"], e["offset"]) for e in salvage_plain(b"x\n" + record + record)] == [
            ("gap", 0), ("record", 2), ("record", 2 + len(record))
        ]


def test_salvage_after_damage(spark, tmp_path):
    data = archive(spark, tmp_path)
    whole = list(salvage_plain(data))
    assert {e["kind"] for e in whole} == {"record"} and len(whole) == 12
    assert sum(e["length"] for e in whole) == len(data)
    rng = random.Random(6)
    for turn in range(60):
        at = rng.randrange(len(data) - 40)
        hurt = {
            0: data[:at] + data[at + 30 :],
            1: data[:at] + bytes(rng.randrange(256) for _ in range(20)) + data[at + 20 :],
            2: data[:at],
            3: data[:at] + b"WARC/1.1\r\n" + data[at:],
        }[turn % 4]
        found = list(salvage_plain(hurt))
        assert sum(e["length"] for e in found) == len(hurt)
        assert [e["offset"] for e in found] == [sum(x["length"] for x in found[:i]) for i in range(len(found))]
        kept = [e["payload"] for e in found if e["kind"] == "record"]
        lost = [e for e in whole if e["offset"] < at + 30 and e["offset"] + e["length"] > at]
        after = [e for e in whole if e["offset"] >= at + 30] if turn % 4 != 2 else []
        before = [e for e in whole if e["offset"] + e["length"] <= at]
        for e in [*before, *after]:
            assert e["payload"] in kept
        assert len(lost) <= 2


def test_salvage_of_members_and_files(spark, tmp_path):
    data = archive(spark, tmp_path)
    records = list(salvage_plain(data))
    members = [gzip.compress(data[r["offset"] : r["offset"] + r["length"]]) for r in records]
    packed = b"".join(members)
    assert [e["payload"] for e in salvage_members(packed)] == [r["payload"] for r in records]
    at = len(b"".join(members[:4])) + 15
    hurt = packed[:at] + b"\0\0\0\0" + packed[at + 4 :]
    found = list(salvage_members(hurt))
    assert sum(e["kind"] == "gap" for e in found) == 1
    assert [e["payload"] for e in found if e["kind"] == "record"] == [r["payload"] for i, r in enumerate(records) if i != 4]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"junk\n" + data)
    (folder / "b.warc.gz").write_bytes(hurt)
    (folder / "c.warc").write_bytes(b"")
    out = read_warc(spark, str(folder))
    assert got(out.groupBy("kind").count(), "kind", "count") == [("gap", 2), ("record", 23)]
    assert out.filter("kind = 'gap' and reason is null").count() == 0


def test_salvage_within_members_and_between_kinds(spark, tmp_path):
    data = archive(spark, tmp_path)
    records = list(salvage_plain(data))
    payloads = [r["payload"] for r in records]

    def kept(archived):
        found = list(salvage_members(archived))
        return [e["payload"] for e in found if e["kind"] == "record"], [e for e in found if e["kind"] == "gap"]

    bad = data[: records[3]["offset"]] + b"XXXX" + data[records[3]["offset"] + 4 :]
    others = payloads[:3] + payloads[4:]
    for level in (0, 6):
        one = gzip.compress(data, level)
        assert kept(one) == (payloads, [])
        # One bad record, a wrong checksum, an end that is cut off, a broken middle.
        assert kept(gzip.compress(bad, level))[0] == others
        assert kept(one[:-8] + b"\0\0\0\0" + one[-4:])[0] == payloads
        assert kept(one[:-3])[0] == payloads
        half = kept(one[: len(one) // 2])
        assert half[0] and half[0] == payloads[: len(half[0])] and half[1]
        # A junk beginning before members, and a plain record among them.
        assert kept(b"junk" + one)[0] == payloads
        first = data[: records[0]["length"]]
        assert kept(one + first + one)[0] == [*payloads, payloads[0], *payloads]
        assert kept(first + b"junk" + one[:-3] + first + one)[0] == [payloads[0], *payloads, payloads[0], *payloads]
        for archived in (one[:-8] + b"\0\0\0\0" + one[-4:], one[:-3], b"junk" + one):
            assert kept(archived)[1] and all(e["reason"] for e in kept(archived)[1])
    three = data[records[0]["offset"] : records[3]["offset"]]
    lines = b"x%d " * 3000 % tuple(range(3000))
    error = gzip.compress(three + lines)
    at = len(gzip.compress(three)) + 200
    assert kept(error[:at] + b"\xff" * 40 + error[at + 40 :])[0] == payloads[:3]
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"junk" + gzip.compress(bad))
    assert read_warc(spark, str(folder)).filter("kind = 'record'").count() == len(others)


# --- toxicity


def test_toxicity_of_held_out_documents(spark):
    out = Q.op9_toxicity(spark, SF_001).filter("held_out")
    labels = spark.read.parquet(f"{SF_001}/labels.parquet")
    n = {(r.toxic, r.predicted): r["count"] for r in out.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.7
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.05


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    plain = "the a and house tree river walks slowly under blue evening sky with some good old friends".split()
    rude = ["moron", "stupid", "idiot"]
    rows = []
    for i in range(400):
        text = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            text[7] = rng.choice(rude)
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    return fit_toxicity(docs, labels, fit_characters(docs))


def test_disguised_words_are_restored(spark, model):
    assert set(model.lexicon) >= {"moron", "stupid", "idiot"}
    for token, word in [("m0r0n", "moron"), ("$tup1d", "stupid"), ("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"),
                        ("stuuuupid", "stupid"), ("mor*n", "moron"), ("house", "house")]:
        assert restore(token, model.characters) == word
    assert "idiot" in words_of("what an i d i o t here", model.characters, {})
    docs = spark.createDataFrame([(1, "you m0r0n!"), (2, "the good house"), (3, "$tup1d  tree"), (4, "an i d i o t")], "doc_id long, text string")
    scores = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert all(scores[i].score >= 0.7 for i in (1, 3, 4)) and scores[2].score < 0.5
    assert scores[1].found == ["moron"]
    assert got(restore_texts(docs, model.characters), "doc_id", "text")[2] == (3, "stupid  tree")


def test_doubled_letters_and_signs_at_the_start(spark, model):
    texts = {
        "stuupid": "stupid", "iddiot": "idiot", "idioot": "idiot", "!diot": "idiot", "|diot": "idiot", "$tupid": "stupid",
        "mo®on": None, "moorron!": "moron", "(!diot)": "idiot", "stupi|d": "stupid", "iiddiioott": "idiot",
    }
    for text, word in texts.items():
        if word:
            assert word in words_of(f"the house {text}, walks", model.characters, {}), text
    assert restored_text("the !diot walks (slowly)!", model.characters) == "the idiot walks (slowly)!"
    assert {"good", "street"} <= words_of("good street!", model.characters, {})
    docs = spark.createDataFrame([(i, t) for i, (t, w) in enumerate(texts.items()) if w], "doc_id long, text string")
    assert score_toxicity(docs, model).filter("score < 0.7").count() == 0
    clean = spark.createDataFrame([(1, "the good house (slowly) walks!"), (2, "all evening tree")], "doc_id long, text string")
    assert score_toxicity(clean, model).filter("score >= 0.7").count() == 0


def all_paths(lattice):
    """Every reading of a lattice: its letters' indices and text, and its cost."""
    for arcs in itertools.product(*lattice):
        yield [i for i, _, _ in arcs if i >= 0], "".join(x for _, x, _ in arcs), sum(c for *_, c in arcs)


def test_viterbi_finds_the_best_of_all_paths(model):
    from eventlens.llm.toxicity import _arcs, _likeliest

    for token in ("1d10t", "$tuupid", "m0r0n", "i.d!0t", "aa11!!", "x*#y"):
        best = -float("inf")
        for letters, text, cost in all_paths(_arcs(token)):
            a, b, score = 0, 0, -cost
            for i in [*letters, 0]:
                score += float(model.characters[a, b, i])
                a, b = (b, i) if i else (0, 0)
            best = max(best, score)
            if text == _likeliest(_arcs(token), model.characters):
                found = score
        assert abs(found - best) < 1e-3, token


def test_spaced_words_are_restored(spark, model):
    texts = {
        "i d 1 0 t": {"idiot"}, "$ t u p i d": {"stupid"}, "$ t u p 1 d": {"stupid"}, "m o r * n": {"moron"},
        "i   d   i     o  t": {"idiot"}, "i\td\ti\to\tt": {"idiot"}, "i\nd\ni\r\no\nt": {"idiot"}, "i\u00a0d\u00a0i\u00a0o\u00a0t": {"idiot"},
        "a i d i o t": {"idiot"}, "a m 0 r 0 n": {"moron"}, "s t u p i d i d i o t": {"stupid", "idiot"},
        "a s t u p i d   m o r o n": {"stupid", "moron"}, "i - d - i - o - t": {"idiot"}, "i.d.i.o.t": {"idiot"},
    }
    for text, words in texts.items():
        for around in ("{}", "the house {} walks", '"{}"', "walks {}!", "river, {}."):
            assert words <= words_of(around.format(text), model.characters, {}), (around, text)
    assert len(words_of("* " * 5000 + "x", model.characters, {})) < 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert score_toxicity(docs, model).filter("score < 0.7").count() == 0
    assert restored_text("the A i d 1 0 t  walks", model.characters) == "the a idiot  walks"


def test_toxicity_of_edge_rows(spark, model):
    out = score_toxicity(P.edge_docs(spark), model)
    assert out.count() == N
    assert out.filter("score is null or score < 0 or score > 1").count() == 0
    assert score_toxicity(P.no_docs(spark), model).count() == 0
    bare = ToxicityModel(fit_characters(P.no_docs(spark)), 0.0)
    assert got(score_toxicity(P.edge_docs(spark), bare).select("score").distinct(), "*") == [(0.0,)]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert fit_toxicity(P.edge_docs(spark), one, bare.characters).lexicon == {}


# --- mixing


def filled(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    left, rest = set(sizes), total
    while left:
        w = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > cap * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / w for s in left}
            break
        for s in over:
            target[s] = cap * sizes[s]
            rest -= cap * sizes[s]
        left -= over
    return target


def test_targets(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {rng.choice("abcdefghé") + str(i): rng.choice([1, 5, 100, 4000]) for i in range(9)} | {None: 50}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        out = {r.source: r.target for r in source_targets(rows).collect()}
        assert out == pytest.approx(filled(sizes))


def test_mix(spark, monkeypatch):
    from eventlens.llm import mixing

    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs)
    first = got(out, "doc_id", "size", "source_size", "target", "copies", "taken")
    assert first == got(mix_sources(docs.repartition(5)), "doc_id", "size", "source_size", "target", "copies", "taken")
    assert len(first) == 3000
    sums = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("c"), F.first("source_size").alias("s")).collect()
    target = filled({r.source: r.s for r in sums})
    for r in sums:
        assert r.g == pytest.approx(target[r.source])
        assert abs(r.t - r.g) <= 40 and r.c <= 3
    assert out.filter("copies not in (floor(target / source_size), ceil(target / source_size)) and size > 0").count() == 0


def test_mix_of_edge_rows(spark):
    out = mix_sources(P.edge_docs(spark))
    assert out.count() == N
    assert out.filter("taken is null or taken > 3 * size or (size = 0 and taken > 0)").count() == 0
    assert mix_sources(P.no_docs(spark)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert got(mix_sources(empty), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_a_long_text_does_not_miss_the_target(spark):
    """One text of a tenth of its source, in several groups and in one."""
    rng = random.Random(2)
    sizes = [rng.randrange(20, 60) for _ in range(800)]
    sizes.append(sum(sizes) // 9)
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)]
    rows += [(10_000 + i, "w " * 50, "b") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(4):
        out = mix_sources(docs, seed=seed).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"))
        assert all(abs(r.t - r.target) <= 60 for r in out.collect())
