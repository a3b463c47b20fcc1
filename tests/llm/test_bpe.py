import base64
import random

import pyarrow as pa
import pytest

from scriptorium.llm import bpe, mixture, pieces, queries


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(queries.tokenizer_path())


@pytest.fixture(scope="module")
def shared(spark, vocabulary):
    return spark.sparkContext.broadcast(vocabulary)


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(queries.tokenizer_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["'s", "'ll", "'", "''", " ", "  ", "\n", "　", "a", "Str", "12", "½", "。", "“", "é", "\U0001f600", "'ve", "\t", "中文", "\xa0", "​", "don't", "<|endoftext|>", "\r\n"]


def ids(v, texts):
    out = []
    for _, _, data, bounds in bpe.chunks(pa.array(texts, pa.string())):
        e = v.encode(data, bounds)
        out += [e.ids[a:b].tolist() for a, b in zip(e.offsets, e.offsets[1:], strict=False)]
    return out


def test_same_ids_as_a_plain_tokenizer(vocabulary, encoding):
    random.seed(5)
    texts = ["".join(random.choices(ODD, k=random.randint(0, 12))) for _ in range(4000)]
    texts += ["a" * 30_000, "ab" * 9_000 + "。", "中" * 9_000, "\n" * 500, None, ""]
    assert ids(vocabulary, texts) == [encoding.encode_ordinary(t or "") for t in texts]


def test_every_token_is_found_whole_and_made_by_merges(vocabulary):
    assert all(vocabulary.merge(t) == [r] for t, r in random.Random(1).sample(sorted(vocabulary.ranks.items()), 4000))
    assert sorted(vocabulary.perfect.key.tolist()) == list(range(len(vocabulary.ranks)))


def test_ids_of_nulls_ties_and_other_columns(spark, shared):
    rows = [(1, "中文 text", "x"), (1, "中文 text", "x"), (2, None, "x"), (3, "", None)]
    got = bpe.token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string"), shared)
    assert got.columns == ["doc_id", "ids"]
    by = sorted((r["doc_id"], len(r["ids"])) for r in got.collect())
    assert by[0] == by[1] and by[2:] == [(2, 0), (3, 0)]
    assert bpe.token_ids(spark.createDataFrame([], "doc_id long, text string"), shared).collect() == []


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (200, 0), (2048, 128)])
def test_pieces_cover_fit_and_overlap(spark, shared, vocabulary, limit, overlap):
    random.seed(limit)
    sentence = lambda: "".join(random.choices("甲乙丙丁abc ", k=random.randint(3, 60))) + random.choice("。！？") + random.choice(["", "", "\n", "\n\n", "\n\n## 题\n"])
    texts = ["".join(sentence() for _ in range(random.choice([5, 300]))) for _ in range(12)] + ["x" * 9_000, "中" * 5_000, None, "", "短"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = {i: len(x) for i, x in enumerate(ids(vocabulary, texts))}
    got = {}
    for r in pieces.pieces(docs, shared, limit, overlap).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {i for i, n in size.items() if n > limit}
    for i, parts in got.items():
        assert parts[0]["first_char"] == 0 and parts[-1]["end_char"] == len(texts[i])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        for p in parts:
            assert p["text"] == texts[i][p["first_char"] : p["end_char"]]
        assert max(map(len, ids(vocabulary, [p["text"] for p in parts]))) <= limit
        for a, b in zip(parts, parts[1:], strict=False):
            assert a["first_char"] < b["first_char"] <= a["end_char"] < b["end_char"]
            assert len(ids(vocabulary, [texts[i][b["first_char"] : a["end_char"]]])[0]) <= overlap + 2


def test_cuts_at_headings_first(spark, shared):
    text = ("字。" * 400 + "\n\n## 题\n") * 4
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pieces.pieces(docs, shared, 2048, 128).orderBy("piece").collect()
    assert [r["cut"] for r in got[:-1]] == ["heading"] * (len(got) - 1)


def test_greedy_cuts_by_brute_force(vocabulary):
    import numpy as np

    text = "".join(f"第{i}句话说到这里。" for i in range(400))
    (_, _, data, bounds), *_ = bpe.chunks(pa.array([text]))
    e = vocabulary.encode(data, bounds)
    _, _, first, last, _, _ = pieces.split_chunk(vocabulary, e, 300, 40)
    b = pieces._Boundaries(e, vocabulary)
    at, want = 0, []
    while True:
        natural = [j for j in range(len(b.byte)) if b.level[j] >= pieces.SENTENCE]
        reach = [j for j in natural if at < j and b.cost[j] - b.cost[at] <= 300]
        end = len(b.byte) - 1 if b.cost[-1] - b.cost[at] <= 300 else max(reach)
        want.append((b.byte[at], b.byte[end]))
        if end == len(b.byte) - 1:
            break
        at = min(j for j in natural if j > at and b.cost[j] >= b.cost[end] - 40)
    assert list(zip(first, last, strict=True)) == want and np.all(np.diff(first) > 0)


def test_mixture(spark):
    rows = [(i, "big", 10) for i in range(4000)] + [(10_000 + i, "small", 10) for i in range(50)] + [(1, None, 10), (2, "other", 10)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 5), ("none", 0.1, 5), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    table = mixture.rates(counts, targets, 20_000)
    rate = {r["source"]: r["rate"] for r in table.collect()}
    assert rate == {"big": 0.25, "small": 3.0, "none": 0.0}
    drawn = mixture.draw(counts, table)
    by = {r["source"]: (r["count"], r["m"]) for r in drawn.groupBy("source").agg({"*": "count", "copy": "max"}).toDF("source", "count", "m").collect()}
    assert by["small"] == (150, 3) and 850 <= by["big"][0] <= 1150 and set(by) == {"big", "small"}
    report = {r["source"]: r for r in mixture.report(drawn, table).collect()}
    assert report["none"]["drawn_tokens"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert sorted(drawn.collect()) == sorted(mixture.draw(counts.repartition(7), table).collect())


def test_mixture_of_nothing(spark):
    counts = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    table = mixture.rates(counts, targets)
    assert mixture.draw(counts, table).collect() == [] and mixture.report(mixture.draw(counts, table), table).first()["actual_share"] == 0
