import hashlib
import random
import re
import time
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontamination, language, licenses, quality, secrets, simhash, toxicity
from tests.llm import plain

D = "/root/testdata/sf0.001"
EDGE = [(900, None), (901, ""), (902, " \n "), (None, "x y z")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("w", F.lit(1)).repartition(2)


def test_secrets(spark):
    r = random.Random(1)
    word = lambda k: "".join(r.choice("0123456789abcdefABCDEFxyzQRS+/_"[:k]) for _ in range(r.randint(18, 45)))
    bits = [word(16), word(31), word(31), word(6), "token", "secret=", "Password: ", "api_key", '"', " = ", "AKIA", "ABCDEF0123456789ABCD", "deadbeef" * 4, "abc", "é", "\n", "x9Qk2LmZ7pR4tV8wB3nY6c", "="]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(200)] + EDGE
    assign = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for x in secrets.scan(frame(spark, rows)).collect():
        text = dict(rows)[x.doc_id] or ""
        a = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        b = [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        c = [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(a + b + c, key=lambda v: (v[1], secrets.KINDS.index(v[0]))))
        assert (x.n_assign, x.n_access, x.n_hex, x.base_sha256) == (len(a), len(b), len(c), hashlib.sha256(base.encode()).hexdigest())
        assert x.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in plain.spans(text))
    assert secrets.masked(frame(spark, [(1, "a token = abcdef12 b")])).first().text == "a <secret> b"


def test_licenses(spark):
    r = random.Random(2)
    bits = ["MIT", "License", "cc", "by", "apache", "gnu", "general", "public", "the", "É", "7"]
    rows = [(i, "".join(r.choice(bits) + r.choice([" ", ", ", "\n"]) for _ in range(r.randint(0, 25)))) for i in range(200)] + EDGE
    notice = "permission to use copy modify and or distribute this software for any purpose with or without any fee is hereby granted"
    rows.append((950, f"x y {notice}."))
    for x in licenses.scan(frame(spark, rows)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[x.doc_id] or ""))
        at = [(i, v) for i in range(len(w)) for p, v in licenses.PHRASES.items() if w[i : i + len(p.split())] == p.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(at), first, last, ",".join(sorted({v for _, v in at})))
        assert x.doc_id != 950 or (x.labels == "isc" and x.score > 0.9)


def test_decontamination(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(30)]
    changed = [word() if i % 5 == 4 else w for i, w in enumerate(item)]
    rows = [(1, " ".join([word() for _ in range(50)] + item)), (2, " ".join(changed)), (3, " ".join(word() for _ in range(200))), (4, " ".join(item[:6])), *EDGE]
    tests = spark.createDataFrame([(7, " ".join(item).upper()), (8, None), (9, "short")], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.overlaps(frame(spark, rows), tests).collect()} == {(1, 7), (2, 7)}
    leak = (None, " ".join(item))
    assert {x.doc_id for x in decontamination.clean(frame(spark, [*rows, leak, (3, leak[1])]), tests).collect()} == {3, 4, 900, 901, 902, None}
    assert decontamination.clean(frame(spark, [leak, (3, leak[1]), (3, "kept")]), tests).collect()[0].text == "kept"
    assert decontamination.overlaps(frame(spark, rows), tests.limit(0)).count() == 0


def test_simhash(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijkl") * 3 for _ in range(120)) for _ in range(12)]
    rows = [(i, re.sub("aaa", r.choice(["aaa", "bb"]), r.choice(base), count=r.randint(0, 2))) for i in range(80)] + EDGE[:3]

    def plain(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: plain(t) for i, t in rows}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[a]] == root[a] for a in fp):
            break
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_classifiers(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    langs = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (langs.lang_pred == langs.lang).mean() > 0.9
    edge = frame(spark, EDGE)
    assert {x.doc_id: x.lang_pred for x in language.identify(edge, docs).collect()}[900] == "und"
    for op in (toxicity, quality):
        got = op.classify(docs, labels).toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all()
        assert op.classify(edge, labels.limit(0)).count() == 4


def stretches(d, b):
    """Equal words and share at best, first and last word: every stretch of every diagonal, without masks."""
    out = []
    for c in range(1 - len(b), len(d)):
        same = [d[i] == b[i - c] for i in range(max(0, c), min(len(d), len(b) + c))]
        for s, e in combinations(range(len(same) + 1), 2):
            n = sum(same[s:e])
            if same[s] and same[e - 1] and n >= 8 and 5 * n >= 4 * (e - s):
                out.append((n, s - e, max(0, c) + s, max(0, c) + e - 1))
    return (max(out)[0], max(out)[0] / -max(out)[1], min(x[2] for x in out), max(x[3] for x in out)) if out else None


def test_decontamination_without_masks(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = {n: [word() for _ in range(n)] for n in (8, 9, 10, 16, 30)}
    docs = {}
    for n, item in items.items():
        for k in range(60):
            off = set(range(k % 5, n, 5)) if k < 5 else set(r.sample(range(n), r.randint(0, n // 4)))
            part = item[: r.choice([n, n, n - 2])]
            own = [word() if i in off else w for i, w in enumerate(part)]
            docs[n * 100 + k] = [word() for _ in range(r.choice([0, 7]))] + own + [word() for _ in range(r.choice([0, 7]))]
    want = {(i, n): s for i, d in docs.items() for n, b in items.items() if (s := stretches(d, b))}
    tests = spark.createDataFrame([(n, " ".join(b)) for n, b in items.items()], "item_id bigint, text string")
    got = decontamination.overlaps(frame(spark, [(i, " ".join(d)) for i, d in docs.items()]), tests).collect()
    assert {(x.doc_id, x.item_id): tuple(x)[2:] for x in got} == want and len(want) > 150


def test_masks_hit_all_short_stretches():
    for n in range(8, 17):
        for off in combinations(range(1, n - 1), n // 5):
            places = [(m, s) for m in decontamination.MASKS for s in range(n - max(m))]
            assert n - len(off) < 8 or any(all(s + o not in off for o in m) for m, s in places)


def test_languages_of_many_letters(spark):
    """Three invented languages of 900 letters each, the first two of one script, beside the given ones."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(6)
    rows = []
    for k, first in enumerate((0x4E00, 0x4E00, 0xAC00)):
        script = [chr(first + i) for i in range(900)]
        words = ["".join(r.choices(script, k=r.randint(1, 3))) for _ in range(700)]
        share = [1 / (i + 1) for i in range(700)]
        rows += [(10_000 * (k + 1) + i, "".join("".join(r.choices(words, share, k=9)) + "\u3002" for _ in range(40)), f"x{k}") for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    own = got.lang.str.startswith("x", na=False)
    assert own.sum() > 20 and (got.lang_pred == got.lang)[own].all() and (got.lang_pred == got.lang)[~own].mean() > 0.9
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert kept.where("lang LIKE 'x%'").count() == len(rows)


def test_long_candidates_take_time_in_proportion(spark):
    """A megabyte without a break, ten thousand short matches in a row, and characters of several bytes between secrets."""
    r = random.Random(11)
    blob = "".join(r.choice("BCFGHJKLNPQRSTVWXYZbcfghjklnpqrstvwxyz0123456789+/") for _ in range(1_000_000))
    assert not re.search(secrets.ALLOWED, blob)
    many = "".join(f"é token={i:06d} \n" for i in range(10_000))
    rows = [(1, blob), (2, many), (3, f"\U0001f600é {blob[:40]}\U0001f600 {blob[40:80]} ü")]
    began = time.time()
    got = {x.doc_id: x for x in secrets.scan(frame(spark, rows)).collect()}
    text = {x.doc_id: x.text for x in secrets.masked(frame(spark, rows)).collect()}
    assert got[1].spans == "entropy:0:1000000" and got[2].n_assign == 10_000 and got[2].spans.endswith(f"assign:{len(many) - 14}:{len(many) - 2}")
    assert text[1] == "<secret>" and text[2] == "é <secret> \n" * 10_000 and text[3] == plain.masked(rows[2][1])
    assert time.time() - began < 150


def test_placeholders_beside_secrets_are_no_excuse(spark):
    key = "x9Qk2LmZ7pR4tV8wB3nY6c"
    rows = [(1, f"a {'A' * 9}{key}{key[::-1]} b"), (2, f"a sample/{key} b"), (3, "a sample_sample_sample_1234567 b"), (4, "a " + "A1" + "A" * 40 + " b")]
    got = {x.doc_id: x.text for x in secrets.masked(frame(spark, rows)).collect()}
    assert all(key not in got[i] and "<secret>" in got[i] for i in (1, 2)) and got[4] == rows[3][1]
    old = {x.doc_id: x.spans for x in secrets.scan(frame(spark, rows)).collect()}
    assert not any(old.values())  # as in the SQL
