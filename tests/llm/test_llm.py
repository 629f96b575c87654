"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm import ann, encoding, linededup, mixing, packing, quality, sharding, simhash, tokenbin, urlfilter, warc
from tidemill.llm.common import gapless, scratch, stored
from tidemill.llm.components import components

SPACES = " \t\n\x0b\x0c\r"
WORDS = "the of and to in that is was for it with as his on be at by this had not are but from or have".split()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    lines = [prose(rng, rng.randint(5, 12)) for _ in range(12)]
    docs = [None, "", " \n\t\n ", "one", "Two words", "ÀÉ ß e\u0301 İ 日本 🙂", "a\x0bb\x1cc \xa0d", "x" * 70_000, prose(rng, 6000)]
    for _ in range(40):
        docs.append("\n".join(rng.choice(lines) if rng.random() < 0.5 else prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 8))))
    docs += [docs[12], docs[12], docs[13] + " more", docs[14].upper(), " ".join(["buy now cheap pills today at best price"] * 30)]
    return docs


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, f"s{i % 3}" if i % 10 else None, i) for i, t in enumerate(texts)]
    rows += [(9, texts[3], "s0", 3), (None, "no id here but some words follow it", "s1", 0), (None, None, None, None)]
    names = "doc_id long, text string, source string, lines int"
    return stored(spark.createDataFrame(rows, names).select("*", F.lit("en").alias("lang"), *[F.lit(1).alias(c) for c in ("n_words", "kept", "fp", "row", "given", "drops", "rate", "copy", "_text", "batch", "shard")]), "test-docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# common

def test_gapless_and_components(spark):
    df = stored(spark.createDataFrame([(k, i % 4) for k in ("a", "b", None) for i in range(50 if k == "a" else 7)], "k string, i int"), "test")
    got = collections.defaultdict(list)
    for k, n in rows_of(gapless(df, ["k"], ["i"], "n", 10), "k", "n"):
        got[k].append(n)
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(50)), "b": list(range(7)), None: list(range(7))}
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(3, 3), (None, 4)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node", "root"))
    assert found == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 1

def test_ann(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    points = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    points[200:500] = points[200]  # a very common vector
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [float("inf")] + [1.0] * 23), (2400, [1.0] * 23 + [None]), (None, points[0].tolist()), (2500, [1.0, 2.0]), (7, points[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("cell", F.lit(2))
    got = collections.defaultdict(list)
    for q, rank, v, score in sorted(rows_of(ann.search(df, F.col("vec_id") % 50 == 0, 10), "query_id", "rank", "vec_id", "score")):
        got[q].append((rank, v, score))
    exact = points.astype(np.float64)
    hits = 0
    assert sorted(got) == list(range(0, 1500, 50))
    for q, found in got.items():
        distance = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), distance)) if i != q][:10]
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - distance[v]) < 1e-9 for _, v, s in found)
        assert found == sorted(found, key=lambda x: (x[2], x[1]))
        hits += len({v for _, v, _ in found} & set(order))
    assert hits / (10 * len(got)) >= 0.9
    assert got[200] and [v for _, v, _ in got[200]] == list(range(201, 211))
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0, 10)
    assert few.count() == 3


# 2

def test_line_dedup(docs, empty, monkeypatch):
    rows = rows_of(docs, "doc_id", "text")
    holders = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            for line in t.split("\n"):
                key = low(line.strip(SPACES))
                if len(key) >= 20:
                    holders[key].add(i)

    def brute(i, t):
        lines = (t or "").split("\n")
        gone = lambda k: i is not None and len(holders[k]) >= 3 and max(holders[k]) != i
        kept = [x for x in lines if len(low(x.strip(SPACES))) < 20 or not gone(low(x.strip(SPACES)))]
        return (i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), "\n".join(kept)

    want = [brute(i, t) for i, t in rows]
    key = lambda r: [str(x) for x in r]
    for batches, fanout in ((3, 2), (1, 3), (5, 2)):
        got = linededup.line_dedup(docs, digest_only=True, batches=batches, fanout=fanout).collect()
        assert sorted(map(tuple, got), key=key) == sorted((w[0] for w in want), key=key)
    assert sum(w[0][2] for w in want) > 20
    whole = linededup.line_dedup(docs)
    assert whole.columns == docs.columns
    monkeypatch.setattr(linededup.LineRuns, "unseen", lambda self, batch: batch)
    without = linededup.line_dedup(docs, digest_only=True).collect()
    assert sorted(map(tuple, without), key=key) != sorted((w[0] for w in want), key=key)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in whole.collect()) == sorted((str(i), str(None if t is None else w[1])) for (i, t), w in zip(rows, want))
    assert linededup.line_dedup(empty, digest_only=True).count() == 0


# 3

def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    starts = collections.defaultdict(list)
    for i in range(len(words) - 7):
        starts[tuple(words[i : i + 8])].append(i)
    covered = {p for s in starts.values() if len(s) > 1 for i in s for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_measures(docs, empty):
    got = quality.quality(docs)
    assert got.columns[-1] == "kept" and got.count() == docs.count()
    for r in got.collect():
        assert tuple(r[c] for c in [*quality.MEASURES, "base_failed"]) == measures(r["text"]), r["text"][:80]
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty, keep=["doc_id"]).count() == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got.where("kept").collect())
    assert quality.quality_filter(empty).count() == 0


def test_quality_model_against_plain_em(spark):
    rng = random.Random(5)
    names = [f"v_{r.name}" for r in quality.RULES]
    rows = []
    for _ in range(2000):
        good = rng.random() < 0.8
        rows.append([1 if rng.random() < (0.9 if good else 0.5) else -1 if rng.random() < (0.05 if good else 0.8) else 0 for _ in names])
    model = quality.fit(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)))
    prior, right = plain_em(np.array(rows))
    assert abs(model.prior - prior) < 1e-6
    assert np.allclose([model.accuracy[n] for n in names], right, atol=1e-6)
    assert quality.fit(spark.createDataFrame([], ", ".join(f"{n} int" for n in names))).prior == quality.START[0]


def plain_em(votes):
    """Rows of votes one by one, no patterns: prior, and for each rule P(+1 | good) and P(-1 | bad) where it votes."""
    prior, right = quality.START[0], np.array([quality.START[1:]] * votes.shape[1])
    more, (_, on_good, on_bad) = quality.PSEUDO_VOTES, quality.START
    for _ in range(50):
        p = posterior(votes, prior, right)
        seen = lambda w, v: ((votes == v) * w[:, None]).sum(axis=0)
        good = (seen(p, 1) + more * on_good) / (seen(p, 1) + seen(p, -1) + more)
        bad = (seen(1 - p, -1) + more * on_bad) / (seen(1 - p, 1) + seen(1 - p, -1) + more)
        objects = ((votes == -1).sum(axis=0) + more * (1 - on_good + on_bad)) / ((votes != 0).sum(axis=0) + 2 * more)
        switched = bad < 1 - good
        new = np.stack([np.where(switched, 1 - objects, good), np.where(switched, objects, bad)], axis=1)
        new_prior = (p.sum() + more * quality.START[0]) / (len(votes) + more)
        done = max(abs(new_prior - prior), np.abs(new - right).max()) < 1e-4
        prior, right = new_prior, new
        if done:
            break
    return prior, right


def posterior(votes, prior, right):
    plus, minus = np.log(right[:, 0] / (1 - right[:, 1])), np.log((1 - right[:, 0]) / right[:, 1])
    return 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + (votes == 1) @ plus + (votes == -1) @ minus)))


def test_an_unsound_rule_loses_its_weight(spark):
    """One rule objects to a third of all texts, good or bad: its lone objection rejects nothing."""
    rng = random.Random(8)
    names = [f"v_{r.name}" for r in quality.RULES]
    rows = []
    for _ in range(3000):
        good = rng.random() < 0.85
        rows.append([-1 if rng.random() < (0.33 if k == 0 else 0.01 if good else 0.7) else 1 for k in range(len(names))])
    votes = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    model = quality.fit(votes)
    assert abs(model.accuracy[names[0]][0] - 0.67) < 0.05 and abs(model.accuracy[names[1]][1] - 0.7) < 0.06
    lone = spark.createDataFrame([[-1, *[1] * (len(names) - 1)]], votes.schema)
    assert lone.select(model.posterior()).first()[0] > 0.9


def test_quality_on_labels(spark):
    """Verdicts are those of plain EM over single rows; held-out labels, which the model never sees, agree with them."""
    d = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{d}/documents.parquet")
    judged = stored(quality.with_measures(texts.select("doc_id", "text")).select("given.doc_id", "base_failed", *[r.vote() for r in quality.RULES]), "test-votes")
    rows = judged.where("NOT base_failed").collect()
    votes = np.array([list(r[2:]) for r in rows])
    p = posterior(votes, *plain_em(votes))
    want = {r["doc_id"]: x >= 0.5 for r, x in zip(rows, p) if abs(x - 0.5) > 1e-3}
    got = quality.quality(texts, keep=["doc_id"])
    kept = dict(rows_of(got, "doc_id", "kept"))
    assert len(want) > 0.99 * len(rows) and all(kept[i] == k for i, k in want.items())
    j = got.where("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in j}
    assert share[1] > 0.98 and share[0] < 0.1
    report = quality.vote_report(texts)
    assert report.count() == len(quality.RULES)
    assert all(r["right_on_bad"] >= 1 - r["right_on_good"] - 1e-9 for r in report.collect())


# 4

def test_sharding(docs, empty, spark):
    got = sharding.shard_by_bytes(docs, n_shards=4).collect()
    assert len(got) == docs.count()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(docs, "doc_id", "text"))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_by_bytes(empty, n_shards=4).count() == 0
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else prose(rng, rng.randint(1, 80)), "big" if i % 2 else f"s{i % 7}", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    even = sharding.shard_by_bytes(df, n_shards=12).groupBy("shard").agg(F.sum("size"), F.countDistinct("text_crc32")).collect()
    total = [r[1] for r in even]
    assert len(even) == 12 and max(total) < 1.06 * sum(total) / 12 and min(total) > 0.94 * sum(total) / 12
    assert sharding.shard_by_bytes(df, n_shards=None, target_bytes=100_000).select("shard").distinct().count() == -(-sum(total) // 100_000)


# 5

ODD = ["", " ", "a  b", "\n\nFoo bar.\n\n  baz, qux!?. ,x", "it's We'll I'M 's", "a\xa0 b\u3000\n c", "x\x85 y", "<|endoftext|> foo<|endoftext|>bar", "foo.. bar., (baz)\tq\r\nzip", "日本語, and 🙂", None, "tab\t\tz", "...\n..."]


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder(texts, name, kind):
    own = encoding.Encoder(public_tokenizers.path(name), 1, remember=50)
    assert own.kind == kind and own.width == 2
    rng = random.Random(4)
    made = ["".join(rng.choices(["a", "B", " ", "  ", "\n", ".", ",", "é", "'s", "1", "\t", "***", "the", "ß", "\xa0", "\x0b", "\x1c", "<|endoftext|>", "e\u0301"], k=rng.randint(1, 25))) for _ in range(3000)]
    for batch in (ODD, texts, made[:1500], made[1500:]):
        for text, ids in zip(batch, own.encode_all(batch, at_once=500)):
            assert np.frombuffer(ids, own.dtype).tolist() == [*own.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text


def test_token_files(spark, docs, empty):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "test-tokens")
    plain = Tokenizer.from_file(path)
    manifest = tokenbin.write_token_files(docs, folder, path, end=1)
    got = rows_of(tokenbin.read_token_files(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    ids = {(i, t): [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows_of(docs, "doc_id", "text")}
    left = collections.Counter((i, len(ids[i, t]), zlib.crc32(np.array(ids[i, t], "<u4").tobytes())) for i, t in rows_of(docs, "doc_id", "text"))
    at = 0
    for i, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
        left[i, n, crc] -= 1
    assert not any(left.values()) and at == manifest["ids"]
    order = [i for i, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    some = next(t for i, t in rows_of(docs, "doc_id", "text") if i == order[10])
    assert tokenbin.token_ids(folder, 10).tolist() == ids[order[10], some]
    nothing = scratch(spark, "test-none")
    tokenbin.write_token_files(empty, nothing, path)
    assert tokenbin.read_token_files(spark, nothing).count() == 0


# 6

def bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    prints = [bits(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group)]


def test_simhash(docs, empty):
    rows = rows_of(docs, "doc_id", "text")
    want = brute_components(rows)
    key = lambda r: [str(x) for x in r]
    assert sorted(rows_of(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id"), key=key) == sorted(want, key=key)
    stay = simhash.simhash_dedup(docs)
    assert stay.columns == docs.columns
    assert sorted((str(r["doc_id"])) for r in stay.collect()) == sorted({str(c) for _, _, c in want})
    assert simhash.simhash_components(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("dense", [1_000, 2])
def test_links(spark, dense):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        for _ in range(6):
            q = p
            for k in rng.sample(range(64), rng.randint(1, 3)):
                q ^= 1 << k
            prints.add(q)
    prints |= {0, (1 << 64) - 1, 1 << 63, 3}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = stored(spark.createDataFrame([(p,) for p in [*signed, None, 0]], "fp long"), "test-prints")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    got = rows_of(simhash.links(df, dense=dense), "fp_a", "fp_b")
    assert set(got) == want and len(got) == len(want) and len(want) > 200


# 7

def test_mixing(spark, docs, empty):
    rng = random.Random(11)
    rows = [(i, prose(rng, 20), "hot" if i % 2 else f"s{i % 6}") for i in range(4000)] + [(None, None, None), (1, "x", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, {"hot": 3.0}, growth=1.5, seed=4)
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(df, {"hot": 3.0}, 1.5).collect()}
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode()) + 1
    for s in size:
        assert math.isclose(rates[s], min(16, 1.5 * sum(size.values()) * (3 if s == "hot" else 1) / (len(size) - 1 + 3) / size[s]))

    def copies(i, s):
        u = (int(hashlib.md5(f"4:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        k, term, upto = 0, math.exp(-rates[s]), math.exp(-rates[s])
        while upto < u and k < 63:
            k += 1
            term *= rates[s] / k
            upto += term
        return k

    want = collections.Counter((i, s, c) for i, _, s in rows for c in range(copies(i, s)))
    assert collections.Counter(rows_of(got, "doc_id", "source", "copy")) == want
    keys = [r[0] for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == mixing.mix(docs, keep=["doc_id"]).count()
    assert mixing.mix(empty).count() == 0


# 8

def test_warc(spark):
    rows = [(3, "u", "aa"), (1, "http://x\r\ny", "aa"), (2, None, None), (5, "q", ""), (None, "z", "aa"), (9, "w", "é" * 300_000), (9, "w", "é" * 300_000), (10, "w", "é" * 300_000), (11, "v", "b\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("record_type", F.lit(0))
    got = rows_of(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    firsts = collections.defaultdict(list)
    for i, _, h in rows:
        firsts[h or ""] += [] if i is None else [i]
    want = []
    for i, _, h in rows:
        data, first = (h or "").encode(), min(firsts[h or ""], default=None)
        again = first is not None and i != first
        want.append((i, len(data), warc.digest(data)[5:], "revisit" if again else "response", first if again else None))
    assert collections.Counter(got) == collections.Counter(want)
    only = rows_of(warc.round_trip(pages, min_bytes=3), "record_type")
    assert only.count(("revisit",)) == 1
    folder = scratch(spark, "test-warc")
    warc.write_pages(pages, folder)
    read = spark.read.format("warc").load(folder)
    picked = read.where("record_type = 'response' AND target_uri LIKE 'w%'")
    assert "BatchScan warc" in picked._jdf.queryExecution().toString()
    assert [r["payload"].decode() for r in picked.collect()] == ["é" * 300_000] * 2
    assert read.where("refers_to IS NULL AND record_type IN ('revisit')").count() == 0
    warc.page_records(pages).write.format("warc").option("gzip", "false").mode("append").save(folder + "-plain")
    assert spark.read.format("warc").option("verify", "true").load(folder + "-plain").count() == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_foreign_warc(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nabc"
    record = lambda kind, data: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (kind, len(data)) + data + b"\r\n\r\n"
    records = [record(b"response", body), record(b"request", b"GET / HTTP/1.1\r\n\r\n"), record(b"response", body)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    warc.use_warc(spark)
    got = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'response'").collect()
    assert [bytes(r["payload"]) for r in got] == [b"abc"] * 4


# 9

def test_packing_plan():
    rng = random.Random(1)
    for lengths in ([rng.randint(1, 1023) for _ in range(20_000)], [600] * 50, [1] * 3000, [512, 512, 513], []):
        by = collections.Counter(lengths)
        each, sized = packing.linear_groups({k: n for k, n in by.items() if k > 256}, 64)
        assert sum(n for _, n in sized) == sum(n for k, n in by.items() if k > 256)
        left = [n for _, n in sized]
        for pattern, times in packing.configurations([s for s, _ in sized], left, 1024):
            assert sum(sized[i][0] * n for i, n in pattern.items()) <= 1024 and times > 0
            for i, n in pattern.items():
                left[i] -= n * times
        assert not any(left)


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = packing.pack(docs, path, end=2, capacity=256).collect()
    rows = rows_of(docs, "doc_id", "text")
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids), 256), len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = collections.defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    tokens = sum(r["length"] for r in got)
    assert len(placed) <= 1.05 * tokens / 256 + 3
    assert packing.pack(empty, path).count() == 0


# 10

def hosts_linked(html):
    found = []

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            found.extend(low(urlsplit(v.strip()).netloc) for k, v in attrs if k in ("href", "src") and v)

    Links().feed(html)
    return [x for x in found if x]


def pagerank(links, seed, damping=0.85):
    """By power iteration; ``links[a, b]`` go from a to b."""
    out, score = links.sum(axis=1), seed.copy()
    for _ in range(300):
        sent = np.divide(score, out, out=np.zeros_like(score), where=out > 0) @ links
        score = (1 - damping) * seed + damping * (sent + score[out == 0].sum() * (seed / seed.sum() if seed.sum() else seed))
    return score


def test_propagation_with_hubs_and_dangling_hosts(spark):
    rng = random.Random(12)
    names = [f"h{i}.net" for i in range(40)]
    links = collections.Counter((rng.choice(names[:3]) if rng.random() < 0.4 else rng.choice(names[:25]), rng.choice(names)) for _ in range(160))
    pages = [(a, f'<a href="https://{b.upper()}/q">') for (a, b), n in links.items() for _ in range(n)] + [(h, None) for h in names]
    seeds = [(h, 1.0 if i % 9 == 2 else 0.0, 0.5 if i % 7 == 1 else 0.0) for i, h in enumerate(names)]
    hosts = stored(spark.createDataFrame(seeds, "host string, allowed double, blocked double"), "test-hosts")
    edges = stored(urlfilter.host_edges(spark.createDataFrame(pages, "host string, html string")), "test-edges")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlfilter.propagate(hosts, edges).collect()}
    ahead = np.array([[float(links[a, b] if a != b else 0) for b in names] for a in names])
    want = zip(pagerank(ahead, np.array([x[1] for x in seeds])), pagerank(ahead.T, np.array([x[2] for x in seeds])))
    for h, (t, d) in zip(names, want):
        assert math.isclose(got[h][0], t, abs_tol=2e-3) and math.isclose(got[h][1], d, abs_tol=2e-3)
    with pytest.raises(RuntimeError):
        urlfilter.propagate(hosts, edges, rounds=5)


def test_urls(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts) + '<a href="/home">'
    rows = [(1, "http://bad.com/en/1", link("b.org")), (2, "HTTP://Bad.com/en/7?x", "<a href=//b.org/x>"), (3, "http://b.org/q", None), (4, None, "x"), (5, "nothing", "y"), (6, "http://www.EXAMPLE.com/en/77#q", link("good.org")), (7, "http://b.net?u://x/y", None)]
    rows += [(8, "http://farm.org/z", link("bad.com", "bad.com")), (8, "http://farm.org/z", link("bad.com")), (9, "http://bad.com/fr/1", link()), (10, "http://good.org", link("bad.com")), (11, "http://xexample.com/en/7", None), (12, "https://a.example.net/de/8/9", ""), (None, "http://c.es/es/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {}
    for r in urlfilter.judge_urls(pages).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (low(m[1]), m[2]) if m else ("", "")

    def ruled(host, path):
        fit = [(len(r), k, r) for k, r in urlfilter.RULES for n, _, p in [r.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
        return max(fit)[1:] if fit else (None, None)

    # the scores, by plain iteration over a dense matrix; links as an HTML parser sees them
    pages_of, links = collections.defaultdict(list), collections.Counter()
    for _, url, html in rows:
        host = parts(url)[0]
        pages_of[host].append(ruled(*parts(url))[0])
        for x in hosts_linked(html or ""):
            pages_of[x]
            links[host, x] += host != x
    names = sorted(pages_of)
    seed = {kind: np.array([sum(k == kind for k in pages_of[h]) / max(1, len(pages_of[h])) for h in names]) for kind in ("allow", "block")}
    ahead = np.array([[float(links[a, b]) for b in names] for a in names])
    trust, distrust = (dict(zip(names, pagerank(m, seed[kind]))) for m, kind in ((ahead, "allow"), (ahead.T, "block")))
    for i, url, _ in rows:
        host, path = parts(url)
        verdict, rule = ruled(host, path)
        r = got[i][0]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert math.isclose(r["trust"], trust[host], abs_tol=2e-3) and math.isclose(r["distrust"], distrust[host], abs_tol=2e-3)
        assert r["verdict"] == (verdict or ("block" if distrust[host] >= 0.5 and distrust[host] > trust[host] else "allow"))
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


# pipeline

def test_pipeline(spark, docs, empty):
    sf_dir = scratch(spark, "test-sf")
    given = docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))
    given.write.parquet(f"{sf_dir}/documents.parquet")
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        step = stored(stage(spark, step, sf_dir), f"test-{name}")
        if name != "packing":
            assert step.columns == given.columns
        sizes.append(step.count())
    assert sizes[0] == sizes[1] >= sizes[2]
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: json.dumps(r)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(rows_of(whole, *columns), key=key) == sorted(rows_of(step, *columns), key=key)
    nothing = given.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stored(stage(spark, nothing, sf_dir), f"test-empty-{name}")
        assert nothing.count() == 0
