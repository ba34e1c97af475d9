import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadweave.llm import ctw, langid, linededup, minhash, mixing, packing, queries, sharding, topk, vecdedup, warc
from tests.parity import SF, check

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS)


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    text = " ".join(f"w{i % 97}" for i in range(3000))
    return docs(spark, [(1, None, None), (2, "", "a"), (3, " \n ", "a"), (4, "one two", "b"), (5, text, "b"), (5, text, "b"), (6, text + " end", "c"), (None, "one two", "c"), (7, "12 34", None)])


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_near_duplicates_of_odd_rows(spark):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd(spark)).collect())
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1 and got[(4, 1, 4, True)] == 1
    assert got[(5, 97, 5, True)] == 2 and got[(6, 98, 5, False)] == 1 and sum(got.values()) == 9
    kept = minhash.one_of_each(odd(spark))
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 7] and kept.columns == odd(spark).columns
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_near_duplicates_in_small_groups(spark, documents):
    """Groups of two sets: lists go on between groups, and find the same."""
    key = lambda r: (r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
    again = documents.select("*", F.lit(1).alias("id"), F.lit(2).alias("value"), F.lit(3).alias("print"), F.lit(4).alias("component_id"))
    want = sorted(map(key, minhash.near_duplicates(documents).collect()))
    assert sorted(map(key, minhash.near_duplicates(again, chunk=2).collect())) == want
    assert minhash.one_of_each(again).columns == again.columns


def test_links_within_a_group():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 260, replace=False), rng.integers(0, 1 << 60, n).astype(np.uint64)])) for n in rng.integers(0, 90, 60)]
    least = np.array([minhash.least_shared(len(s), 128, 75, 1e-7) for s in sets])
    root = np.arange(len(sets))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    root[i] = root[j] = min(root[i], root[j])
        if (root[root] == root).all():
            break
    assert minhash.linked(sets, least, 128, 75).tolist() == root.tolist()


def test_mixture_meets_targets(spark, documents):
    rows = mixing.mix_digest(documents).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source_size"], r["target"]] += r["size"]
        assert r["taken"] <= 2 * r["size"]
    by = {r["doc_id"]: r["source"] for r in documents.collect()}
    largest = Counter()
    for r in rows:
        s = by[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6 * sum(target.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_digest(documents.repartition(7)).collect()))
    mix = mixing.mix_sources(documents)
    drawn = Counter(r["doc_id"] for r in mix.select("doc_id").collect())
    assert all(drawn[r["doc_id"]] == r["draws"] for r in rows)
    assert mixing.mix_digest(odd(spark)).count() == 9 and mixing.mix_sources(odd(spark).limit(0)).count() == 0


def test_mixture_is_dealt_by_the_tree(spark, documents, monkeypatch):
    mix = mixing.mix_sources(documents, shards=8)
    parts = mix.select(F.spark_partition_id().alias("part"), "mix_shard", "mix_order", "source").collect()
    whose, by = {}, defaultdict(list)
    for r in parts:
        by[r["part"]].append((r["mix_shard"], r["mix_order"]))
        assert whose.setdefault((r["mix_shard"], r["mix_order"] >> 58), r["part"]) == r["part"]
    assert all(x == sorted(x) for x in by.values()) and {r["mix_shard"] for r in parts} == set(range(8))
    whole = sum(r["draws"] for r in mixing.mix_digest(documents, shards=8).collect())
    assert whole == len(parts)
    split, shares = mixing.split_quotas, Counter(r["mix_shard"] for r in parts)
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, rng: split(q, n, rng) if n < 8 else np_without_last(split(q, n, rng)))
    assert sum(r["draws"] for r in mixing.mix_digest(documents, shards=8).collect()) == whole - shares[7]


def np_without_last(quotas):
    quotas[-1] = 0
    return quotas


def test_packing_round_trip(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: encoder.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in documents.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(documents).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, want in ids.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            part = want[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(want)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack_documents(odd(spark)).count() >= 9


def test_top_k_of_odd_vectors(spark):
    v = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 5 << 20), (100, 2, 2, 5 << 20), (100, 3, 3, -(1 << 20))]


def test_shards(spark, documents):
    rows = queries.op5_shard_documents(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    load, slots, group = Counter(), defaultdict(list), {}
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert group.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(16))
    assert max(load.values()) <= 1.05 * sum(load.values()) / 16
    assert sharding.shard_documents(odd(spark)).count() == 9


def test_runs_place_as_one_by_one():
    import random

    rng = random.Random(1)
    for _ in range(200):
        items, bins = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))], rng.randint(1, 9)
        capacity = max(max(items), -(-sum(items) // bins)) + rng.randint(0, 5)
        classes, room, want = sorted(Counter(items).items()), [capacity] * bins, Counter()
        for x in sorted(items, reverse=True):
            fits = [(room[b], b) for b in range(bins) if room[b] >= x]
            if not fits:
                want = None
                break
            room[min(fits)[1]] -= x
            want[x, min(fits)[1]] += 1
        got = sharding.best_fit_decreasing(classes, capacity, bins)
        assert (got is None) == (want is None)
        if want is not None:
            assert {(s, b): n for (s, _), runs in zip(classes, got) for b, n in runs} == want
            best = sharding.pack_classes(classes, bins)
            assert all(sum(n for _, n in runs) == count for (_, count), runs in zip(classes, best))


def test_shards_of_odd_rows(spark):
    rows = odd(spark).select("*", *[F.lit(k).alias(c) for k, c in enumerate(("own_shard", "sh_group", "class", "run", "g", "base", "bins", "slot"))])
    got = sharding.with_slots(sharding.shard_documents(rows, shards=3)).collect()
    assert len(got) == 9 and all(r["own_shard"] == 0 and r["class"] == 2 and r["sh_group"] == 1 and r["bins"] == 6 for r in got)
    at = defaultdict(set)
    for r in got:
        at[r["text"]].add(r["shard"])
    assert all(len(x) == 1 for x in at.values()) and next(iter(at[None])) in (0, 1, 2)
    assert sharding.with_slots(sharding.shard_documents(rows.limit(0))).count() == 0
    sizes = [1, 8191, 8192, 8193, 16383, 1 << 20, (1 << 20) + 1, (1 << 40) + 1]
    classes = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "s long").select(sharding.size_class(F.col("s"))).collect()]
    assert all(x <= c <= x * (1 + 1 / 4096) and c.bit_length() <= x.bit_length() + 1 for x, c in zip(sizes, classes)) and classes[:4] == [1, 8191, 8192, 8194]


def test_clashing_columns(spark):
    names = ["target", "of", "head", "draws", "mix_key", "mix_of", "mix_ends", "mix_size", "source_size", "ld_doc", "ld_of", "ld_mark", "window", "pos", "first"]
    rows = odd(spark).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    same = lambda got: all(r[c] == k for r in got for k, c in enumerate(names))
    mixed = mixing.mix_sources(rows)
    assert mixed.columns == [*rows.columns, "mix_shard", "mix_order"] and same(mixed.collect()) and mixed.count() == mixing.mix_sources(odd(spark)).count()
    assert mixing.mix_digest(rows).count() == 9
    edited = linededup.dedup_lines(rows)
    assert edited.columns == [*rows.columns, "n_lines", "n_removed"] and edited.count() == 9 and same(edited.collect())
    named = langid.identify(rows)
    assert named.count() == 9 and same(named.collect())
    packed = packing.pack_documents(rows)
    assert packed.columns == packing.pack_documents(odd(spark)).columns
    assert ctw.score_documents(rows).count() == 9


def test_scores_of_odd_rows(spark):
    got = defaultdict(list)
    for r in ctw.score_documents(odd(spark)).collect():
        got[r["doc_id"]].append(r)
    assert [got[i][0]["n_tokens"] for i in (1, 2, 3, 4, 7)] == [1, 1, 1, 3, 3] and len(got[5]) == 2 and got[5][0] == got[5][1]
    assert got[None][0]["held_out"] and got[None][0]["score"] == got[4][0]["score"] and got[1][0]["score"] == got[2][0]["score"]
    none = docs(spark, [(i, "x y", "s") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])
    rows = ctw.score_documents(none).collect()
    assert rows and all((r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and math.isclose(r["score"], 4 * -8 * math.log10(2)) for r in rows)


def test_vectors_of_other_lengths_and_repeats(spark):
    v = spark.createDataFrame([(100, [0.0, 0.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (200, [1.0, 1.0, 1.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0")).collect())
    assert got == [(100, 1, 1, 0), (100, 2, 1, 0), (200, 1, 2, 6 << 20)]
    w = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    rows = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vecdedup.near_duplicates(w).collect())
    assert rows[(1, 2, 1, True)] == 2 and rows[(2, 2, 1, False)] == 1 and rows[(3, 0, 3, True)] == 1 and sum(rows.values()) == 5


def test_hot_cell_of_vectors(spark):
    """One cell over the size of a chunk: 2500 near-equal vectors, all linked."""
    v = spark.range(2500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") * 1e-6).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    got = vecdedup.near_duplicates(v).agg(F.min("n_links"), F.max("component_id"), F.count_if("kept"), F.count("*")).first()
    assert tuple(got) == (2499, 0, 1, 2500)


def test_warc_of_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    rows = warc.read_records(warc.read_chunks(warc.write_archives(pages, str(tmp_path / "w")))).collect()
    assert len(rows) == 5 and sorted(r["payload_bytes"] for r in rows) == [0, 0, 1, 1, 1]


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    for f in (packing.pack_documents, linededup.dedup_lines, langid.identify, ctw.score_documents, minhash.one_of_each):
        assert f(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(vectors, vectors).count() == 0 and vecdedup.near_duplicates(vectors).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    odd(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_equals_brute_force(spark, documents):
    """The same rules with sets of n-grams in place of filters."""
    import re

    def grams(text):
        t = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
        t = re.sub(" +", " ", t)
        return [t[i : i + 4] for i in range(len(t) - 3)]

    rows = documents.collect()
    learned = [r for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    n, holds = Counter(r["lang"] for r in learned), defaultdict(Counter)
    for r in learned:
        for g in set(grams(r["text"])):
            holds[g][r["lang"]] += 1
    own = {}
    for g, by in holds.items():
        rate = {s: k / n[s] for s, k in by.items()}
        own[g] = {s for s, x in rate.items() if x >= 0.003 and x >= 0.3 * max(rate.values())}
    got = {r["doc_id"]: r for r in langid.identify(documents).collect()}
    same = judged = 0
    for r in rows:
        hits = Counter(s for g in grams(r["text"] or "") for s in own.get(g, ()))
        if sum(hits.values()) >= 50:
            best, share = max(hits, key=lambda s: (hits[s], s)), max(hits.values()) / sum(hits.values())
            judged += 1
            same += got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - share) < 0.05
    assert judged > 150 and same == judged


def test_near_vectors_of_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdedup.near_duplicates(v).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True)}


def test_language_accuracy(spark, documents):
    got = langid.identify(documents).collect()
    held = [r for r in got if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(got) == documents.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    rows = langid.identify(odd(spark)).collect()
    assert len(rows) == 9 and all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 7)) for r in rows)


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    body = {r["page_id"]: (r["html"] or "").encode() for r in pages}
    first = {}
    for k, b in body.items():
        first[b] = max(k, first.get(b, k))
    for r in queries.op8_warc_round_trip(spark, SF).collect():
        b = body.pop(r["page_id"])
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[b] == r["page_id"] else ("revisit", first[b]))
    assert not body


def test_warc_long_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 500_000), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    files = warc.write_archives(pages, str(tmp_path / "w"))
    chunks = warc.read_chunks(files).where("record_id = '1'").orderBy("chunk_no").collect()
    assert b"".join(bytes(c["chunk"]) for c in chunks) == ("é" * 500_000).encode() and len(chunks) == 16


def test_line_dedup_of_odd_rows(spark):
    block = "a\nb\nc"
    rows = docs(spark, [(1, block, "s"), (2, f"x\n{block}\nd\n{block}", "s"), (3, None, "s"), (4, "a\nb", "s"), (5, block, "s")])
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(rows).collect()}
    assert got == {1: (block, 0), 2: ("x\nd", 6), 3: (None, 0), 4: ("a\nb", 0), 5: ("", 3)}


def test_scores(spark, documents):
    got = {r["doc_id"]: r for r in ctw.score_documents(documents, most_words=500).collect()}
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, x in text.items() if not out(i) for t in [*words(x), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        tokens = [*words(text[i]), "\n"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert all(0 < r["bits_per_byte"] < 8 for r in held if r["n_tokens"] > 20) and all(r["score"] < 0 for r in held)


def test_byte_model_is_a_distribution():
    import numpy as np

    path = np.zeros(1, np.uint64)
    p = ctw.tree_bits(path, np.array([3]), np.array([1]))
    q = ctw.tree_bits(path, np.array([1]), np.array([3]))
    assert 0 < p[0] < 0.5 < q[0] < 1 and math.isclose(p[0] + q[0], 1)


def test_scores_keep_rare_contexts(spark, documents):
    """Bounds on what is broadcast change no score, and every context of training has its node."""
    import numpy as np

    docs = documents.limit(60)
    texts = [(ctw.words_of((r["text"] or "").encode()), zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2, r["doc_id"]) for r in docs.collect()]
    counts = Counter()
    for w, trains, _ in texts:
        for g in ctw.grams_of([w])[0].tolist():
            counts[g] += trains
    grams = np.array(sorted(counts), np.uint64)
    n, sym = np.array([counts[g] for g in grams.tolist()]), grams & np.uint64(255)
    path = sum(((grams >> np.uint64(8 * (k + 1))) & np.uint64(255)) << np.uint64(9 * (ctw.DEPTH - 1 - k)) for k in range(ctw.DEPTH))
    ln = np.zeros(len(grams))
    for k in range(8):
        prefix, one = (np.uint64(256) | sym) >> np.uint64(8 - k), (sym >> np.uint64(7 - k)) & np.uint64(1) == 1
        for tree in np.unique(prefix):
            some = prefix == tree
            leaves, at = np.unique(path[some], return_inverse=True)
            p = ctw.tree_bits(leaves, np.bincount(at, n[some] * ~one[some]), np.bincount(at, n[some] * one[some]))[at]
            ln[some] += np.log(np.where(one[some], p, 1 - p))
    of = dict(zip(grams.tolist(), ln))
    want = {i: sum(of[g] for g in ctw.grams_of([w])[0].tolist()) / math.log(10) for w, _, i in texts}
    for most in (2_000_000, 300):
        got = {r["doc_id"]: r["score"] for r in ctw.score_documents(docs, most_entries=most).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_pipeline_keeps_what_no_rule_rejects(spark, tmp_path):
    """Small corpus through all five stages: what goes, what stays whole, and how often it is drawn."""
    import random

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    vocabulary = [word() for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randint(20, 200)), "a") for i in range(60)]
    near = text(150)
    block = "\n".join(text(8) for _ in range(3))
    rows += [(100, near, "a"), (101, near, "a"), (102, near + " " + vocabulary[0], "a"), (103, "12 34", "a"), (104, "", "a"), (105, "a", "a")]
    rows += [(106, block, "a"), (107, block + "\n" + text(40), "a"), (7, text(90), "a"), (101, text(70), "a")]
    want = Counter((i, t) for i, t, _ in rows if (i, t) not in {(101, near), (102, rows[62][1]), (103, "12 34"), (104, ""), (107, rows[67][1])})
    want[107, rows[67][1].removeprefix(block + "\n")] += 1
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = Counter()
    for i, t in want:
        size[i, len(encoder.encode(t, add_special_tokens=False).ids) + 1] += 1
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got.keys() == size.keys()
    draws = {k: got[k] / k[1] for k in got}
    assert all(d in (size[k], 2 * size[k]) for k, d in draws.items())
    words_of = {(i, len(encoder.encode(t, add_special_tokens=False).ids) + 1): len(t.split()) for i, t in want}
    assert abs(sum(words_of[k] * d for k, d in draws.items()) - 1.5 * sum(words_of.values())) <= max(words_of.values()) / 2


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, SF).columns == documents.columns
    kept = corpus_pipeline.identify_language(spark, odd(spark), SF)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, None}
