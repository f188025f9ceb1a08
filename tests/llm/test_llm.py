"""The training-data operators on small tables with nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names, against brute force, the libraries or SQL."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from compare import connect, same

from lodestone.llm import ann, bpe, exact_dedup, lm, mixing, near_dedup, queries, shared, token_counts, token_output, toxicity, url_filter, words
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents() -> list[tuple]:
    """Rows of every awkward kind."""
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgäñ'", k=rng.randint(1, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    base = make(120)
    rows = [(i, make(rng.randint(1, 150)), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100 + i, base, "en", "s0", 1) for i in range(12)]  # exact copies
    for i in range(12):  # near copies
        w = base.split()
        w[rng.randrange(120)] = f"new{i}"
        rows.append((200 + i, " ".join(w), "en", "s1", 1))
    rows += [(300, None, None, None, None), (301, "", "de", "s9", 0), (302, " \n\t ", "de", None, 3), (None, "no id here at all", "fr", "s2", 2), (None, base, "fr", "s2", 2)]
    rows += [(303, make(40_000), "en", "s3", 1), (304, "x" * 200_000, "en", "s3", 1), (305, "A b", "en", "s3", 1), (306, "日本語 のテキスト、 ' 's 're don't\r\n  two  blanks ▁ mark 12³", "ja", "é", 1)]
    rows += [(400, "twice the same row", "en", "s0", 1), (400, "twice the same row", "en", "s0", 1), (400, "same id, other text", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """The table with extra columns of the operators' own column names."""
    return df.withColumns({n: F.lit("mine") for n in names})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF).sql(queries.ORACLE_SQL[name]))


# 1: byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_on_random_texts(library):
    rng = random.Random(1)
    alpha = list("abst'remdlv' \n\t  .,!?19éüß中▁ 　²Ⅷ😀\r\x1c\x85") + ["'s", "'re", "'ll", " '", "  ", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choices(alpha, k=rng.randint(0, 60))) for _ in range(4000)] + ["", "a" * 5000, "ab" * 3000 + " " * 700]
    assert bpe.codec(RANKS).encode(texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("chars", [1, 2, 3, 7, 64])
def test_bpe_scan_carries_its_state_on(library, monkeypatch, chars):
    monkeypatch.setattr(bpe, "SCAN_CHARS", chars)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2_000)
    rng = random.Random(chars)
    texts = ["".join(rng.choices(list("abst'relv \n .19é中") + ["'re", "'ll"], k=rng.randint(0, 40))) for _ in range(300)]
    c = bpe.codec(RANKS)
    assert c.encode(texts) == [library.encode_ordinary(t) for t in texts]
    held = c.held
    c.encode(texts)
    assert held == c.held == sum(160 + 2 * len(p) for p in c.known)  # the cache had started afresh


def test_bpe_takes_only_its_pattern():
    with pytest.raises(ValueError):
        bpe.Codec(RANKS, r"\w+")
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_bpe_classes_are_made_in_little_memory():
    """Workers make them when a task begins, beside all that the executor holds: they had taken some 100 MB for a table of one."""
    import tracemalloc

    made = bpe._class_table()
    tracemalloc.start()
    again = bpe._class_table.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (again == made).all() and peak < 8 << 20


def test_bpe_round_trip(docs, empty, library):
    want = Counter()
    for i, t, *_ in odd_documents():
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = bpe.round_trip(clashing(docs, "n_tokens", "ids_sha256", "ids"), RANKS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_bpe_encode_offsets_and_decode(docs):
    rows = bpe.decode(bpe.encode(clashing(docs, "ids", "starts", "decoded"), RANKS), RANKS).collect()
    assert len(rows) == len(odd_documents())
    tokens = {rank: token for token, rank in bpe.codec(RANKS).ranks.items()}
    for r in rows:
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw
        assert all(raw[s : s + len(tokens[i])] == tokens[i] for s, i in list(zip(r["starts"], r["ids"]))[:50])


# 2: URL filter


def test_url_filter_odd_urls(spark):
    urls = [None, "", "no scheme", "http://NET/", "http://a.net", "http://a.net?x", "https://A.Example.NET/en/x#y", "https://example.net/EN/", "x://example.com/de/", "x://notexample.com/de/", "a://b://org/fr/", "http://org/fr/q?u=http://net/", "http://foo.net:80/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls + urls)], "page_id long, url string, rule string")
    df = clashing(df, "_best", "_url", "judged", "judged_url", "token", "action")
    rules = [*queries.URL_RULES, ("block", "x/.*"), ("block", "b/ads")]

    def judge(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(r), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])] if m else []
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {(i, *judge(u)) for i, u in enumerate(urls + urls)}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_url_rules_without_bounded_token(spark):
    df = spark.createDataFrame([(1, "http://h/abc"), (2, "http://h.h/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, [("block", "-/"), ("block", "h/ab")]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_word_hashes_do_not_depend_on_the_span(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abé", k=rng.choice([1, 3, 9, 40, 200]))) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    want = words.word_hashes(texts)[0]
    for span in (16, 64):
        monkeypatch.setattr(words, "SPAN", span)
        words._powers.cache_clear()
        assert (words.word_hashes(texts)[0] == want).all()
    words._powers.cache_clear()


# 3: token counts


def test_token_counts(docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in odd_documents())
    got = token_counts.count_tokens(clashing(docs, "n_bytes", "n_tokens", "over_limit"), PIECES)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_token_counts_on_random_blanks():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(2)
    texts = ["".join(rng.choices(list("ab é▁\n\t 中") + [" ", "  ", "<s>"], k=rng.randint(0, 30))) for _ in range(5000)]
    assert token_counts.PieceCounter(PIECES).counts(texts) == [len(sp.encode(t)) for t in texts]


# 4: toxicity


def toxic_texts(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices(["ta", "re", "lo", "mi", "su", "ka", "ne"], k=rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(5, 300))
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grobix", "grobbix", "grobixen", "grobi" + rng.choice("xyz")])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_finds_unseen_misspellings():
    train = toxic_texts(1200, 1)
    model = toxicity.train([t for _, t, _ in train], np.array([y for *_, y in train]), 0.25)
    clean = [t for _, t, y in toxic_texts(300, 9) if not y]
    bad = [t + " grobixxen" for t in clean[:100]]
    assert (toxicity.score_texts(model, bad) >= 0.3).mean() > 0.95
    assert (toxicity.score_texts(model, clean) >= 0.3).mean() < 0.05


def test_toxicity_operator(spark, docs, empty):
    rows = toxic_texts(600, 3)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "mi su")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (4, 0), (123456, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    scored = toxicity.score(clashing(d, "score"), model).collect()
    assert len(scored) == 603 and all(0 <= r["score"] <= 1 for r in scored)
    held = {r["doc_id"] for r in d.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in [*range(600), 9001, 9002] if zlib.crc32(str(i).encode()) % 4 == 2}
    kept = toxicity.drop_toxic(clashing(d, "score", "_score", "toxicity_score", "_toxicity_score_", "__text", "row"), labels)
    assert kept.columns == ["doc_id", "text", "score", "_score", "toxicity_score", "_toxicity_score_", "__text", "row"] and 0 < kept.count() < 603
    none = toxicity.fit(empty, labels)
    assert toxicity.score(docs, none).count() == docs.count() and toxicity.score(empty, none).count() == 0


def test_toxicity_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels)
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(d.join(F.broadcast(known), "doc_id"), model).select("toxic", (F.col("score") >= 0.3).alias("p")).collect()
    hit = sum(r["p"] for r in got if r["toxic"] == 1)
    assert hit / sum(r["toxic"] == 1 for r in got) > 0.75 and hit / sum(r["p"] for r in got) > 0.8, (hit / sum(r["toxic"] == 1 for r in got), hit / sum(r["p"] for r in got))


# 5: shards


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 1000, 4096, 4097):
        assert sorted(token_output.feistel(np.arange(n), n, 3).tolist()) == list(range(n))
    assert (token_output.feistel(np.arange(1000), 1000, 1) != token_output.feistel(np.arange(1000), 1000, 2)).any()


@pytest.mark.parametrize("size", [token_output.SHARD_TEXT_BYTES, 40_000])
def test_shards(spark, docs, empty, library, tmp_path, monkeypatch, size):
    monkeypatch.setattr(token_output, "SHARD_TEXT_BYTES", size)
    stored = shared.written(clashing(docs, "slot", "seq"), "t")
    out = token_output.write_shards(stored, RANKS, public_tokenizers.PATTERN, f"file://{tmp_path}/a", seq_len=64)
    rows = out.collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows))) and len({r["slot"] for r in rows}) == len(rows)
    assert [r["position"] for r in sorted(rows, key=lambda r: r["slot"])] == list(range(len(rows)))
    back: dict = {}
    for r in rows:
        (record,) = token_output.read_records(f"file://{tmp_path}/a", r["shard"], r["byte_offset"] // 128, 1, 64)
        assert len(record) == r["n_tokens"] and hashlib.sha256(",".join(map(str, record.tolist())).encode()).hexdigest() == r["ids_sha256"]
        back.setdefault(r["doc_id"], []).append((r["seq"], record.tolist()))
    for i, t, *_ in odd_documents():
        if t and i is not None and i != 400:
            assert [x for _, part in sorted(back[i]) for x in part] == library.encode_ordinary(t)
    assert token_output.write_shards(shared.written(empty, "t"), RANKS, public_tokenizers.PATTERN).count() == 0


# 6: language model


def brute_base(rows):
    toks = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, *_ in rows]
    c = Counter()
    for (i, *_), w in zip(rows, toks):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [(i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for (i, *_), w in zip(rows, toks)]


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 20, 0])
def test_lm_base_scores_are_exact(docs, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    d = clashing(docs, "score", "row")
    model, rest = lm.fit(d.filter(~lm.held_out(F.col("doc_id"))))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in lm.score(d, model, rest).collect()), key=str)
    want = sorted(brute_base(odd_documents()), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])


def test_lm_empty(spark, docs, empty):
    model, rest = lm.fit(empty)
    assert lm.score(docs, model, rest).count() == docs.count()
    assert lm.score(empty, model, rest).count() == 0


def test_lm_beats_its_base_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rest = lm.fit(d.filter(~lm.held_out(F.col("doc_id"))))
    got = lm.score(d.filter(lm.held_out(F.col("doc_id"))), model, rest).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_filter_reads_back_counts():
    keys = words.mix(np.arange(1, 5001, dtype=np.uint64))
    counts = np.random.default_rng(0).integers(1, 5000, 5000)
    import pyarrow as pa

    t = pa.table({"part": [0], "words": [keys.tobytes()], "word_counts": [counts.astype("<u4").tobytes()], "pairs": [b""], "pair_counts": [b""]})
    made = lm._merged(t, lm.BITS)
    f = lm.Filter(np.frombuffer(made.column("bits")[0].as_py(), np.uint8), np.array([0, 8 * len(made.column("bits")[0].as_py())]))
    want = lm.levels(np.array(made.column("counts")[0].as_py() and np.frombuffer(made.column("counts")[0].as_py(), np.int64)), 1)
    got = f.level(*lm.word_key(np.frombuffer(made.column("words")[0].as_py(), np.uint64)))
    assert (got >= want).all() and (got == want).mean() > 0.97
    fresh = words.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))
    assert (f.level(*lm.word_key(fresh)) > 0).mean() < 0.02


def test_lm_filter_has_its_bits_for_every_item_in_large_texts(spark):
    """600 MB of text, nearly all blanks: 24,000 words keep 12 bits each (and not 7, as a bound by bytes of text gave)."""
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), F.col("id") * 200 + i)), " "), F.repeat(F.lit(" "), 5_000_000))
    model, _ = lm.fit(spark.range(0, 120, 1, 16).select(text.alias("text")))
    assert model.v == 24_001 and 8 * len(model.counts.bits) >= 12 * 24_000


def test_lm_filter_level_ends_at_the_largest_stored_one():
    keys = words.mix(np.arange(1, 101, dtype=np.uint64))
    full = lm.Filter(np.full(64, 255, np.uint8), np.array([0, 512]), 7)  # all bits set
    assert (full.level(*lm.word_key(keys)) == 7).all()


def test_lm_stores_pairs_seen_once():
    """Every pair of the training texts counts, those that occur once too."""
    import pyarrow as pa

    pairs = words.mix(np.arange(1, 2001, dtype=np.uint64)) >> np.uint64(16)
    t = pa.table({"part": [0], "words": [b""], "word_counts": [b""], "pairs": [lm._pack48(pairs)], "pair_counts": [np.ones(2000, "<u4").tobytes()]})
    made = lm._merged(t, lm.BITS).column("bits")[0].as_py()
    f = lm.Filter(np.frombuffer(made, np.uint8), np.array([0, 8 * len(made)]))
    assert (f.level(*lm.pair_key(pairs)) >= 1).all()
    assert lm.level_counts(lm.PAIR_CUTOFF)[1] == 1


def test_lm_weights_are_learned_on_all_documents(spark):
    """The weights see every token of 5,000 documents, as expectation maximisation token by token does."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{int(i**1.5)}" for i in range(200)], k=rng.randint(1, 30))) for _ in range(5_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model, _ = lm.fit(df)
    rows = lm._leveled(df.withColumn("row", F.monotonically_increasing_id()), model, ["row"]).collect()
    word, pair = (np.frombuffer(b"".join(r[c] for r in rows), np.uint8).astype(np.int64) for c in ("words", "pairs"))
    assert len(word) == model.n == sum(len(t.split()) + 1 for t in texts)
    context = model.contexts(word, np.cumsum([0, *(len(r["words"]) for r in rows[:-1])]))
    every = (context * lm.LEVELS + pair) * lm.LEVELS + word
    got, model.weights = model.weights, np.full(lm.LEVELS, 0.2)
    model.learn_weights(every, np.ones(len(every)))
    assert got == pytest.approx(model.weights)


def exact_twin(rows):
    """Scores by the same smoothing from exact counts in dictionaries, without hashes or filter."""
    toks = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, *_ in rows]
    train = [w for (i, *_), w in zip(rows, toks) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([0, *w], w))
    level = lambda n, cutoff=1: int(lm.levels(np.array([n]), cutoff)[0])
    at = lambda a, b: (level(len(train) if a == 0 else one[a]), level(two[a, b], lm.PAIR_CUTOFF), level(one[b]))
    model = lm.Model(None, None, sum(one.values()), len(one), len(train), 0, np.full(lm.LEVELS, 0.2), *[np.zeros(0)] * 2)
    codes = Counter(at(a, b) for w in train for a, b in zip([0, *w], w))
    model.learn_weights(np.array([(c * lm.LEVELS + p) * lm.LEVELS + w for c, p, w in codes]), np.array(list(codes.values())))
    out = []
    for w in toks:
        c, p, x = (np.array(y) for y in zip(*(at(a, b) for a, b in zip([0, *w], w))))
        seen, single = model._estimates(c, p, x)
        out.append(float(np.log10(model.weights[c] * seen + (1 - model.weights[c]) * single).sum()))
    return out


@pytest.mark.parametrize("room", [lm.MAX_FILTER_BYTES, 0])
def test_lm_scores_equal_those_of_exact_counts(spark, monkeypatch, room):
    """But for the filter's errors (half a percent of the levels); with no room for a broadcast the ranges are asked."""
    monkeypatch.setattr(lm, "MAX_FILTER_BYTES", room)
    rng = random.Random(6)
    rows = [(10_000 + i, " ".join(rng.choices([f"w{int(k**1.6)}" for k in range(150)], k=rng.randint(0, 60))), "en", "s", 1) for i in range(1_500)] + odd_documents()
    df = clashing(spark.createDataFrame(rows, SCHEMA), "score", "words", "pairs", "row", "block")
    got = lm.fit_and_score(df, lm.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    texts = {i: (r, w) for r, w in zip(rows, exact_twin(rows)) for i in [r[0]] if i not in (None, 400)}
    errors = [abs(g["score"] - texts[g["doc_id"]][1]) / g["n_tokens"] for g in got if g["doc_id"] in texts]
    assert np.mean(errors) < 0.01 and np.quantile(errors, 0.99) < 0.1
    model, rest = lm.fit(df.filter(~lm.held_out(F.col("doc_id"))))
    again = lm.score(df, model, rest).collect()
    assert Counter((g["doc_id"], g["n_known"], round(g["score"], 9), round(g["base_score"], 9)) for g in got) == Counter((g["doc_id"], g["n_known"], round(g["score"], 9), round(g["base_score"], 9)) for g in again)
    assert (model.counts is None) == (room == 0)


def test_lm_range_is_probed_once_for_all_blocks(monkeypatch):
    """Beyond a broadcast, a range answers 500 blocks in one probe of words and one of pairs, as if each asked alone."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys = np.unique(words.mix(np.arange(1, 3001, dtype=np.uint64)))
    counts = rng.integers(1, 50, len(keys))
    t = pa.table({"part": [0], "words": [keys.tobytes()], "word_counts": [counts.astype("<u4").tobytes()], "pairs": [lm._pack48(keys >> np.uint64(16))], "pair_counts": [counts.astype("<u4").tobytes()]})
    held = lm._merged(t, lm.BITS)
    whole = lm.Filter(np.frombuffer(held.column("bits")[0].as_py(), np.uint8), np.array([0, 8 * len(held.column("bits")[0].as_py())]), held.column("top")[0].as_py())
    asks = [np.sort(rng.choice(keys, n, replace=False)) for n in rng.integers(0, 40, 500)]
    asked = pa.table({"block": list(range(500)), "part": pa.array([0] * 500, pa.int32()), "words": [lm._pack_sorted(x) for x in asks], "pairs": [lm._pack_sorted(x >> np.uint64(16)) for x in asks]})
    want = [[whole.level(*key(x)).tolist() for x in xs] for key, xs in ((lm.word_key, asks), (lm.pair_key, [x >> np.uint64(16) for x in asks]))]
    probes, level = [], lm.Filter.level
    monkeypatch.setattr(lm.Filter, "level", lambda self, *a: probes.append(1) or level(self, *a))
    got = lm._answered(asked, held, whole.top)
    assert len(probes) == 2 and got.column("block").to_pylist() == list(range(500))
    assert [[list(x) for x in got.column(c).to_pylist()] for c in ("words", "pairs")] == want


def test_lm_workers_map_the_filter_and_hold_no_copy(spark):
    import pickle

    import pyarrow as pa

    bits = np.random.default_rng(2).integers(0, 256, 3 << 20, np.uint8)
    sent = spark.sparkContext.broadcast(pickle.PickleBuffer(bits))

    def run(batches):
        for b in batches:
            got = lm._sent_bits(sent)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(got)] * len(b)), pa.array([isinstance(got.base, np.memmap)] * len(b))], names=["crc", "mapped"])

    rows = spark.range(0, 8, 1, 4).mapInArrow(run, "crc long, mapped boolean").distinct().collect()
    assert [tuple(r) for r in rows] == [(zlib.crc32(bits), True)]
    few = spark.sparkContext.broadcast(pickle.PickleBuffer(bits[:10]))
    assert (lm._sent_bits(few) == bits[:10]).all()


def test_lm_sorted_keys_travel_as_differences():
    for n in (0, 1, 1000):
        x = np.sort(np.random.default_rng(n).integers(0, 2**64 - 1, n, np.uint64))
        assert (lm._unpack_sorted(lm._pack_sorted(x)) == x).all()


# 7: exact dedup


def test_exact_dedup(spark, docs, empty, monkeypatch):
    for least in (exact_dedup.HOT_MIN, 2):
        monkeypatch.setattr(exact_dedup, "HOT_MIN", least)
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", 50)
        groups: dict = {}
        for i, t, *_ in odd_documents():
            groups.setdefault(t or "", []).append(i)
        got = exact_dedup.exact_dedup(clashing(docs, "kept", "keep_id", "c0")).collect()
        assert len(got) == len(odd_documents())
        by: dict = {}
        for r in got:
            by.setdefault(r["text_sha256"], []).append(r)
        assert len(by) == len(groups)
        for t, ids in groups.items():
            rows = by[hashlib.sha256(t.encode()).hexdigest()]
            keep = max((i for i in ids if i is not None), default=None)
            assert {(r["keep_id"], r["group_size"]) for r in rows} == {(keep, len(ids))}
            assert sum(r["kept"] for r in rows) == 1 and sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in rows)
        kept = exact_dedup.drop_exact_copies(clashing(docs, "kept", "_text", "c0"))
        assert kept.columns == [*docs.columns, "kept", "_text", "c0"] and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


# 8: nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    x[100:130] = x[100]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [float("nan")] * 16), (5400, [None] + [1.0] * 15), (5500, [1.0] * 3), (None, [1.0] * 16), (200, x[200].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(clashing(df, "score", "rank")).collect()
    x = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 900, 100):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want.tolist()))
    assert hits >= 0.9 * 90 and len(got) == 90
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert sorted(r["vec_id"] for r in ann.nearest(few).collect()) == [1, 2, 3]
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("norms", [(1.0, 1.0), (0.5, 2.0)])
def test_probing_leaves_rows_out_and_finds_the_nearest(norms):
    """On vectors without clusters, the hardest case, with equal and with varying norms."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6_000, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(*norms, (len(x), 1))
    coder = ann.learn(x[:4_000], 10)
    codes = coder.codes(x)
    index, hits = ann.SubstringIndex(codes), 0
    for q in range(0, 6_000, 100):
        rows = index.within(codes[q], coder.radius)
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(rows[np.argsort(d[rows])[:10]].tolist()))
    assert hits >= 0.9 * 600
    assert index.probed / (60 * 6_000) < (0.3 if norms[0] == norms[1] else 0.6), index.probed / (60 * 6_000)


def test_pigeonhole_finds_every_code_within_the_radius():
    codes = np.random.default_rng(1).integers(0, 1 << 16, (2000, 8)).astype(np.uint16)
    codes[:300] = codes[300] ^ (np.random.default_rng(2).random((300, 8)) < 0.2)
    index = ann.SubstringIndex(codes)
    for r in (0, 3, 7, 20, 57):
        want = np.flatnonzero(ann.hamming(codes, codes[300]) <= r)
        assert index.within(codes[300], r).tolist() == want.tolist()


# 9: mixing


def water(sizes: dict, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, docs, empty):
    size = lambda t: len(WORD.findall(t or ""))
    sizes: dict = {}
    for _, t, _, s, _ in odd_documents():
        sizes[s] = sizes.get(s, 0) + size(t)
    target = water(sizes)
    clash = clashing(docs, "size", "target", "shard", "row", "rid", "s", "k", "tie", "c", "nth", "copy", "h")
    digest = mixing.mix_digest(clash, block_words=500, n_shards=5).collect()
    as_rows = lambda rows: Counter(str((r["doc_id"], r["size"], r["taken"], r["copies"])) for r in rows)
    assert as_rows(digest) == as_rows(mixing.mix_digest(clash.repartition(3), block_words=500, n_shards=5).collect())
    source = {(i, size(t)): s for i, t, _, s, _ in odd_documents()}
    taken: dict = {}
    for r in digest:
        s = source[r["doc_id"], r["size"]]
        assert r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[s]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(digest) == len(odd_documents()) and all(abs(taken[s] - target[s]) <= 1 for s in target)
    out = mixing.mixed_rows(docs, length_col="n_chars")
    words_out: dict = {}
    for r in out.collect():
        words_out[r["source"]] = words_out.get(r["source"], 0) + size(r["text"])
    assert out.columns == docs.columns and all(abs(words_out.get(s, 0) - target[s]) <= 1 for s in target)
    assert mixing.mixed_rows(clash, whole=True).columns == clash.columns
    assert mixing.mix_digest(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mixing_takes_what_the_tree_deals(docs, monkeypatch):
    """The mix's rows come shard after shard, and without the tree's quotas nothing is taken."""
    copies = sorted((c["shard"], c["place"], r["doc_id"]) for r in mixing.mix_digest(docs, block_words=500, n_shards=5).collect() if r["doc_id"] not in (None, 400) for c in r["copies"])
    by_partition = mixing.mixed_rows(docs, block_words=500, n_shards=5, whole=True).withColumn("p", F.spark_partition_id()).collect()
    found = {}
    for r in by_partition:
        found.setdefault(r["p"], []).append(r["doc_id"])
    whole = {}
    for shard, _, i in copies:
        whole.setdefault(shard, []).append(i)
    got = [[i for i in ids if i not in (None, 400)] for ids in found.values()]
    assert sorted(i for ids in got for i in ids) == sorted(i for _, _, i in copies)
    assert all(any(ids[k : k + len(part)] == part for ids in got for k in range(len(ids))) for part in whole.values())
    tree = mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a: tree(*a).filter("false"))
    assert all(r["taken"] == 0 and not r["copies"] for r in mixing.mix_digest(docs).collect())


@pytest.mark.parametrize("good,total,draws", [(5, 12, 4), (40, 100, 50), (1, 1000, 3), (7, 7, 3), (0, 9, 4), (30, 60, 60)])
def test_hypergeometric_law(spark, good, total, draws):
    n = 4_000
    k = mixing.hypergeometric(F.lit(good), F.lit(total), F.lit(draws), (F.col("id") + 0.5) / n)
    got = Counter(r["k"] for r in spark.range(n).select(k.alias("k")).collect())
    for i in range(max(0, draws - total + good), min(draws, good) + 1):
        want = math.comb(good, i) * math.comb(total - good, draws - i) / math.comb(total, draws)
        assert abs(got.get(i, 0) / n - want) <= 2 / n
    assert sum(got.values()) == n


def test_splitting_tree_of_a_billion_blocks(spark):
    quotas = spark.createDataFrame([("a", 600_000_000), ("b", 399_999_000), ("c", 1_000)], "source string, blocks long")
    leaves = mixing.shard_quotas(quotas, 4, 1).collect()
    by = Counter()
    for r in leaves:
        by[r["source"]] += r["blocks"]
    assert by == {"a": 600_000_000, "b": 399_999_000, "c": 1_000}
    a = [r["blocks"] for r in leaves if r["source"] == "a"]
    assert len(a) == 4 and all(abs(x - 150_000_000) < 8 * 7_000 for x in a) and len(set(a)) > 1


def test_mixing_deals_every_copy_and_keeps_documents_whole(spark, docs):
    import corpus_pipeline

    for r in mixing.mix_digest(docs, block_words=500, n_shards=5).collect():
        assert sum(c["words"] for c in r["copies"]) == r["taken"]
        assert all(0 <= c["shard"] < 5 and c["place"] is not None for c in r["copies"])
    texts = {t for _, t, *_ in odd_documents()}
    assert all(r["text"] in texts for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())


def test_splitting_tree_deals_every_block_once(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 7), (None, 0), ("c", 33)], "source string, blocks long")
    leaves = mixing.shard_quotas(quotas, 6, 1).collect()
    by: dict = {}
    for r in leaves:
        by.setdefault(r["source"], []).append(r)
    assert {s: sum(r["blocks"] for r in v) for s, v in by.items()} == {"a": 100, "b": 7, "c": 33}
    shards = Counter()
    for v in by.values():
        at = 0
        for r in sorted(v, key=lambda r: r["shard"]):
            assert r["first"] == at
            at += r["blocks"]
            shards[r["shard"]] += r["blocks"]
    assert set(shards) == set(range(6)) and max(shards.values()) - min(shards.values()) <= 3


# 10: near duplicates


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up: dict = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x, y = rows[i][0], rows[j][0]
            if a and b and x is not None and y is not None and 100 * len(a & b) >= 85 * len(a | b):
                p, q = top(x), top(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
    return Counter((r[0], len(s), top(r[0]) if r[0] is not None else None) for r, s in zip(rows, sets))


def test_near_duplicates(docs, empty):
    got = near_dedup.near_duplicates(clashing(docs, "n", "cls", "kept")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(odd_documents())
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    clash = clashing(docs, "gone", "__gone", "id", "cls")
    assert near_dedup.drop_near_copies(clash).columns == clash.columns
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block,shingles", [(near_dedup.BLOCK_ROWS, near_dedup.BLOCK_SHINGLES), (7, near_dedup.BLOCK_SHINGLES), (near_dedup.BLOCK_ROWS, 900)])
def test_near_duplicates_in_chains_and_crowds(spark, monkeypatch, block, shingles):
    """Copies of copies, and a crowd that shares most of a text without being near copies of each other."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(near_dedup, "HOT_MIN", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 2_000_000 if block == 7 else 0)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, text = [], [word() for _ in range(200)]
    for i in range(40):  # each a few words from the one before
        text = text[:]
        for _ in range(2):
            text[rng.randrange(200)] = word()
        rows.append((1000 - i, " ".join(text)))
    crowd = [word() for _ in range(100)]
    for i in range(80):
        w = crowd[:]
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(100)] = word()
        rows.append((2000 + i, " ".join(w)))
    passage = " ".join(word() for _ in range(60))
    rows += [(2500 + i, rows[-1][1]) for i in range(9)]  # a hot class
    rows += [(3000 + i, f"{passage} " + " ".join(word() for _ in range(rng.choice([3, 20, 60])))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_near_copies_at_each_threshold(spark):
    """Three groups of two texts with 100 shingles each: .78, .82 (a link at 80 only) and .9."""
    import corpus_pipeline

    rows = []
    for g, common in enumerate((88, 90, 95)):  # of 100 shingles: 88 / 112, 90 / 110, 95 / 105
        w = [f"g{g}w{i}" for i in range(104)]
        rows += [(10 * g + 1, " ".join(w), "en", "s", 1), (10 * g + 2, " ".join([*w[: common + 4], *(f"other{g}x{i}" for i in range(100 - common))]), "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    linked = lambda percent: {r["doc_id"] for r in near_dedup.near_duplicates(df, percent=percent).collect() if not r["kept"]}
    assert linked(80) == {12, 22} and linked(85) == {22}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()} == {1, 2, 11, 21}


def test_word_hashes_tell_words_apart():
    texts = ["Abc abc ABC", "", " x ", "é É", "a" * 3_000_000 + " b"]
    h, upto = words.word_hashes(texts)
    assert upto.tolist() == [3, 3, 4, 6, 8]
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 6


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.written(stage(spark, docs, SF), name)
        assert after.columns == corpus_pipeline.COLUMNS
        if name != "mixing":
            assert docs.count() * 0.5 < after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
