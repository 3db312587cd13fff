"""Text operators against brute force, exact round trips and odd inputs."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from runscore.llm import fuzzy_lines, leakage, metric_tree, near_copies, toxic_passages, words
from runscore.llm.chat import chat_digests, format_chats, read_chats
from runscore.llm.fuzzy_lines import line_groups, without_repeated_lines
from runscore.llm.isotonic import calibrate, isotonic_blocks
from runscore.llm.mixture import fly, land, mix_plan, mixed
from runscore.llm.queries import END_ID, JOBS, TOKENIZER
from runscore.llm.shards import shard_documents
from runscore.llm.token_files import ROW_GROUP_BYTES, WordEncoder, read_tokens, token_digests, write_token_files
from runscore.llm.toxic_passages import Passages, maximal_segments, score_toxicity, without_toxic

DOCS = "doc_id long, text string, source string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " \n\t", None, "one", "one two", "é" * 50, "a " * 3000, "x" * 20_000, "tab\tand\x0bfeed"]


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [random.choice(vocabulary) for _ in range(60 + 10 * base)]
        for copy in range(6):
            changed = list(text)
            for _ in range(copy % 4):
                changed[random.randrange(len(changed))] = random.choice(vocabulary)
            rows.append(" ".join(changed))
    rows += ODD + ODD[3:5]
    data = [(i, t, ("a", "b", None)[i % 3], 0.5) for i, t in enumerate(rows)] + [(None, "no id here at all", "b", 0.1)]
    return spark.createDataFrame(data, DOCS)


def test_word_hashes_follow_the_words():
    texts = ["The the THE", None, "", " a\tb\nc ", "ab ba", "é É"]
    hashes, bounds, _, _ = words.word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [3, 0, 0, 3, 2, 2]
    assert len(set(hashes[:3].tolist())) == 1 and hashes[6] != hashes[7]
    assert hashes[8] != hashes[9]  # only A-Z are lower-cased


def test_near_copies_equal_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in near_copies.near_copies(docs).collect()}
    sets, label = {}, {}
    for row in docs.where("doc_id is not null").collect():
        found = [w.lower() for w in WORD.findall(row["text"] or "")]
        shingles = set(zip(found, found[1:], found[2:])) if len(found) > 2 else ({tuple(found)} if found else set())
        sets[row["doc_id"]], label[row["doc_id"]] = shingles, row["doc_id"]
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {k: r["component_id"] for k, r in got.items() if k is not None} == label
    assert all(got[k]["n_shingles"] == len(s) for k, s in sets.items())
    assert got[None]["component_id"] is None
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*label.values(), None}


def test_sketch_distance_never_exceeds_difference():
    random.seed(5)
    for _ in range(50):
        a = np.unique(words.mix(np.array(random.sample(range(10**6), 80), dtype=np.uint64)))
        b = np.unique(np.concatenate([a[: random.randrange(80)], words.mix(np.arange(20, dtype=np.uint64))]))
        apart = sum(int(x).bit_count() for x in near_copies.whole_sketch(a) ^ near_copies.whole_sketch(b))
        assert apart <= len(np.setxor1d(a, b))


def _least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for a in pattern:
        following = [row[0] + 1]
        for j, b in enumerate(text):
            following.append(min(row[j] + (a != b), row[j + 1] + 1, following[j] + 1))
        row = following
    return min(row)


def test_leakage_finds_what_the_edit_budget_allows():
    random.seed(1)
    for _ in range(60):
        item = leakage.normalised("".join(random.choice("abcd ") for _ in range(90)))
        text = list(item)
        for _ in range(random.randint(0, 9)):
            k = random.randrange(len(text))
            text[k : k + random.randint(0, 1)] = random.choice(["z", "", "zz"])
        text = leakage.normalised("dcba" * random.randint(0, 9) + "".join(text) + "abcd" * 5)
        index = leakage.Index([(1, item)])
        least = _least_edits(index.windows[0].tolist(), leakage.code_points(text).tolist())
        found = index.matches(leakage.code_points(text))
        assert bool(found) == (least <= index.edits[0])
        assert not found or min(m[3] for m in found) == least


def test_leakage_finds_every_quote_of_the_stated_length():
    random.seed(2)
    item = "".join(random.choice("abcdefghij") for _ in range(400))
    index = leakage.Index([(1, item)])
    length = leakage.WINDOW + leakage.STRIDE - 1
    assert length == 103
    for begin in range(0, len(item) - length + 1, 3):
        text = "zyx" * 20 + item[begin : begin + length] + "wvu" * 20
        assert index.matches(leakage.code_points(text)), begin


def test_leakage_query_keeps_clean_rows(spark, docs):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of odd colours near the quiet lake"
    bench = spark.createDataFrame([(7, passage), (8, None), (9, "")], "item_id long, text string")
    dirty = spark.createDataFrame([(900, f"Before.\n{passage.upper()} after", "a", 1.0)], DOCS)
    both = docs.union(dirty)
    assert [(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(both, bench).collect()] == [(900, 7)]
    assert leakage.without_leaks(both, bench).count() == docs.count()
    assert leakage.find_leaks(both, bench.where("false")).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    odd = ["a  b", " x", "x ", "a\n b\n\nc", "<|endoftext|> x y", "it's  'tis", "   x y", "é 12 3.4"]
    encoder = WordEncoder(TOKENIZER)
    for text, raw in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, TOKENIZER, END_ID)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    back = {r["doc_id"]: r for r in token_digests(spark, path).collect()}
    start = 0
    for row in rows:
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [END_ID]
        got = back[row["doc_id"]]
        assert (got["start"], got["n_tokens"]) == (start, len(ids))
        assert got["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert read_tokens(spark, path, 3, 5).count() == 3


def test_token_file_layout(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * j) % 50}" for j in range(200))) for i in range(4000)]
    path = str(tmp_path / "tokens")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # the table is small, but several files are wanted
    spark.conf.set(coalesce, "false")
    try:
        write_token_files(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), path, TOKENIZER, END_ID)
    finally:
        spark.conf.unset(coalesce)
    files = sorted(str(p) for p in Path(path).glob("*.parquet"))
    lows = []
    for file in files:
        meta = pq.ParquetFile(file).metadata
        for number in range(meta.num_row_groups):
            group = meta.row_group(number)
            assert group.total_byte_size <= ROW_GROUP_BYTES + (8 << 20)
            columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert "DELTA_BINARY_PACKED" in columns["start_in_part"].encodings
            assert all(c.has_column_index and c.has_offset_index for c in columns.values() if c is not ids)
            lows.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    assert len(lows) > 1 and all(a[1] < b[0] for a, b in zip(sorted(lows), sorted(lows)[1:]))
    few = read_tokens(spark, path, 100, 109)
    assert [r["doc_id"] for r in few.orderBy("doc_id").collect()] == list(range(100, 110))
    plan = few.select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "ids:array" not in plan


def test_mixture_reaches_targets(spark, docs):
    plan = mix_plan(docs).toPandas()
    assert len(plan) == docs.count() and plan["copies"].max() <= 3
    assert (plan["taken"] == plan["copies"] * plan["size"]).all()
    assert abs(plan["taken"].sum() - plan["size"].sum()) < 0.02 * plan["size"].sum()
    again = mix_plan(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, plan[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == plan.loc[plan["size"] > 0, "copies"].sum()
    assert mix_plan(docs.where("false")).count() == 0


def test_cube_flight_keeps_both_totals():
    size = np.random.default_rng(1).integers(1, 500, 300)
    chance = np.full(300, 0.37)
    flown = fly(size, chance, 4)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(chance.sum()) and (flown * size).sum() == pytest.approx((chance * size).sum())
    assert abs((land(size, chance, flown) * size).sum() - (chance * size).sum()) < 20


def test_shards_are_even_and_hold_groups(spark, docs):
    copies = spark.createDataFrame([(1000 + i, "same text", "a", 0.0) for i in range(5)], DOCS)
    out = shard_documents(docs.union(copies), 4).toPandas()
    counts = out.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    assert out[out["doc_id"] >= 1000]["shard"].nunique() == 1
    hot = spark.createDataFrame([(i, "hot", "a", 0.0) for i in range(40)], DOCS)
    assert set(shard_documents(hot, 4).toPandas().groupby("shard").size()) == {10}


def test_chat_comes_back_exactly(spark):
    texts = ["<|im_end|><|im_start|>x", "\\<|", "<\\|", "\\\\", "<\\n>", None, "", "a\nb", "<|im_turn|>", "é<"]
    rows = [(1, i, ("user", "assistant", "assistant", "odd\nrole", None)[i % 5], t) for i, t in enumerate(texts)]
    chats = spark.createDataFrame(rows + [(None, None, "user", "x")] * 2, "conv_id long, turn long, role string, text string")
    formatted = format_chats(chats)
    back = {r["conv_id"]: r for r in read_chats(formatted).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows]
    assert back[1]["loss_text"] == "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert len(back[None]["turns"]) == 2
    assert {r["n_turns"] for r in chat_digests(formatted).collect()} == {10, 2}


def test_metric_tree_equals_brute_force(spark):
    random_ = np.random.default_rng(2)
    data = random_.normal(0, 0.2, (600, 8))
    data[100:300] = data[7]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(700, None), (701, [float("nan")] * 8), (702, [None] * 8), (703, [1.0]), (None, [0.1] * 8)]
    got = metric_tree.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    whole = np.floor(256 * data).astype(int)
    for q in range(0, 600, 50):
        want = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert [(-s, v) for s, v in zip(mine["score"], mine["vec_id"])] == want
    assert len(got) == 60


def test_maximal_segments_are_all_found():
    random.seed(9)
    for _ in range(200):
        values = [random.choice([-3, -2, -1, 1, 2, 4]) for _ in range(12)]
        want, todo = [], [(0, 12)]
        while todo:  # the definition: the best segment, then left and right of it
            a, b = todo.pop()
            best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                want.append(best[0])
                todo += [(a, best[3]), (best[4], b)]
        got = [s for _, _, s in maximal_segments(values, [0.0] * 12)]
        assert sorted(got) == sorted(want)


def test_toxicity_without_model_and_with(spark, docs):
    token = words.word_hashes(pa.array(["vile"]))[0]
    model = Passages(token, np.array([5.0]), 1.0, 0.0, np.array([-125.0, 0.0]), np.array([0.01, 0.99]))
    bad = spark.createDataFrame([(2000, "so VILE, vile!", "a", 0.0)], DOCS)
    assert without_toxic(docs.union(bad), model).count() == docs.count()
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs.union(bad), model).collect()}
    assert scores[2000] > 0.9 and scores[0] == pytest.approx(0.01)


def test_isotonic_is_monotone():
    centres, chances = isotonic_blocks(np.arange(5.0), np.full(5, 10.0), np.array([1.0, 3.0, 2.0, 8.0, 9.0]))
    assert (np.diff(calibrate(np.linspace(-1, 6, 50), centres, chances)) >= 0).all()


def test_fuzzy_lines(spark):
    base = [f"token{i}" for i in range(40)]
    near = list(base)
    near[3] = "other"
    rows = [
        (1, " ".join(base) + "\nshort line\n\n"),
        (2, "Short  LINE\n" + " ".join(base)),
        (3, None), (4, ""), (5, "word " * 3000), (5, "unlike"), (6, " ".join(base).upper() + "\nx"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["line_no"]): r for r in line_groups(frame).collect()}
    assert (out[2, 1]["keeper_doc_id"], out[2, 1]["keeper_line_no"], out[2, 1]["kept"]) == (1, 0, False)
    assert out[2, 0]["keeper_doc_id"] == 1 and out[6, 0]["keeper_doc_id"] == 1 and out[6, 1]["kept"]
    texts = {r["doc_id"]: r["text"] for r in without_repeated_lines(frame.where("doc_id != 5")).collect()}
    assert texts[2] == "" and texts[6] == "x" and texts[3] is None and texts[1].endswith("\nshort line\n\n")


def test_fuzzy_lines_of_odd_tables(spark):
    rows = [(1, "same words in this line\nown", 7, "a", 0), (2, "Same words in this  line\nelse", 8, "b", 1), (None, "own", 9, "c", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, Doc int, drops string, doc_ int")
    out = {r["doc_id"]: r for r in without_repeated_lines(frame).collect()}
    assert out[None]["text"] == "own"  # rows without id come first, so this one keeps the line
    assert out[1].asDict() == dict(zip(frame.columns, (1, "same words in this line", 7, "a", 0)))
    assert out[2].asDict() == dict(zip(frame.columns, (2, "else", 8, "b", 1)))
    assert without_repeated_lines(frame.where("false")).columns == frame.columns
    assert without_repeated_lines(frame.where("false")).count() == 0


def test_fuzzy_lines_stand_under_a_fifth_of_their_words(spark, monkeypatch):
    """Rows kept between the steps are about a fifth of the words, whether words are shared or not."""
    base, rows, keep = [f"w{i}" for i in range(100)], [], fuzzy_lines.Scratch.keep

    def counted(*given):
        kept = keep(*given)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(fuzzy_lines.Scratch, "keep", counted)
    lines = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 100, 5)]
    out = line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r["keeper_doc_id"] for r in out} == {0} and max(rows) <= 20 * (100 // 5 + fuzzy_lines.MEETINGS)


@pytest.mark.parametrize("most", [1, 3, fuzzy_lines.MOST_MET])
def test_fuzzy_lines_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(fuzzy_lines, "MOST_MET", most)
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(300)]
    lines = []
    for length in (3, 4, 5, 5, 6, 8, 9, 10, 14, 15, 20, 35, 60, 160):
        for _ in range(3):
            base = random.choices(vocabulary, k=length)
            lines.append(base)
            for _ in range(5):
                changed = list(base)
                for _ in range(random.randint(1, max(1, length // 4))):
                    at = random.randrange(len(changed))
                    changed[at : at + random.randint(0, 1)] = random.choices(vocabulary, k=random.randint(0, 1))
                lines.append(changed or base)
    random.shuffle(lines)

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            left, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (a != b))
        return row[-1]

    label = list(range(len(lines)))
    for a, b in itertools.combinations(range(len(lines)), 2):
        x, y, longer = lines[a], lines[b], max(len(lines[a]), len(lines[b]))
        if label[a] != label[b] and 5 * abs(len(x) - len(y)) <= longer and 5 * edits(x, y) <= longer:
            least, most = sorted((label[a], label[b]))
            label = [least if v == most else v for v in label]
    frame = spark.createDataFrame([(i, " ".join(line)) for i, line in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["keeper_doc_id"] for r in line_groups(frame.repartition(5)).collect()}
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("name", ["op1_quality", "op7_toxic_passages"])
def test_held_out_accuracy(spark, name):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = JOBS[name](spark, path).join(labels, "doc_id").where("held_out").toPandas()
    positive = rows["quality" if name == "op1_quality" else "toxic"] == 1
    # the two kinds of rows apart, as nine in ten texts are not toxic
    assert rows["predicted"][positive].mean() >= 0.85
    assert 1 - rows["predicted"][~positive].mean() >= 0.95


def test_evidence_adds_up_significant_segments():
    model = Passages(np.zeros(0, np.uint64), np.zeros(0), 2.0, 1.0)
    one = model.evidence([9.0], 10)
    assert one == pytest.approx((9.0 - 1.0) / 2.0 - np.log(10))
    assert model.evidence([9.0, 9.0, 9.0], 10) > one  # further significant segments count
    assert model.evidence([9.0, 0.5, 0.2], 10) == pytest.approx(one)  # weak ones change nothing
    assert model.evidence([9.0], 1000) < one and model.evidence([], 10) == toxic_passages.NO_SEGMENT
    assert model.evidence([0.1], 10**9) > toxic_passages.NO_SEGMENT


def toxic_corpus(spark, n=240):
    random.seed(8)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words_ = random.choices(plain, k=random.choice([8, 40, 150]))
        if bad:
            at = random.randrange(len(words_))
            words_[at:at] = ["vile", random.choice(["scum", "rot"]), "vile"]
        rows.append((i, " ".join(words_), "s", 0.0))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_cross_fitted_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    model = toxic_passages.fit_passages(docs, labels)
    known = set(words.word_hashes(pa.array(["vile scum rot"]))[0].tolist())
    assert known <= set(model.tokens.tolist()) and len(model.tokens) <= 8  # a few more by chance
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert all((scores[i] >= 0.3) == (i in toxic) for i in scores)
    # held-out texts and labels play no part
    changed = labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2")
    again = toxic_passages.fit_passages(docs, changed)
    assert (again.tokens == model.tokens).all() and (again.odds == model.odds).all()


def test_toxicity_of_odd_tables(spark):
    docs, labels = toxic_corpus(spark, 60)
    nothing = docs.where("false")
    for d, l in ((nothing, labels), (docs, labels.where("false")), (docs, labels.where("toxic = 0")), (docs, labels.where("toxic = 1"))):
        model = toxic_passages.fit_passages(d, l)
        assert {r["score"] for r in score_toxicity(docs, model).collect()} == {0.0}
        assert without_toxic(docs, model).count() == 60
    model = toxic_passages.fit_passages(docs.union(docs), labels.union(labels.selectExpr("NULL", "toxic")))
    odd = spark.createDataFrame([(None, None, "a", 0.0), (7, "", "a", 0.0), (7, "vile " * 50_000, "a", 0.0), (7, "vile " * 50_000, "a", 0.0)], DOCS)
    clash = odd.selectExpr("doc_id", "text", "source AS evidence", "score AS segments", "1 AS words", "2 AS label", "3 AS fold")
    scores = [r["score"] for r in score_toxicity(clash, model).collect()]
    assert scores[0] == scores[1] < 0.3 and scores[2] == scores[3] >= 0.3
    assert without_toxic(clash, model).columns == clash.columns and without_toxic(clash, model).count() == 2


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas().sort_values("start")
    assert len(corpus_pipeline.STAGES) == 5
    assert (out["start"].to_numpy()[1:] == np.cumsum(out["n_tokens"].to_numpy())[:-1]).all()


def test_long_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size, other in [(0, 1), (1, 1), (31, 33), (64, 65), (900, 1100), (5000, 4100), (5000, 5000)]:
        pool = rng.integers(0, 2**63, 2 * (size + other), dtype=np.uint64)
        shared = min(size, other) // 2
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate([pool[:shared], pool[size : size + other - shared]]))
        x, y = near_copies.long_sketch(a), near_copies.long_sketch(b)
        assert 64 * len(x) >= 2 * len(a) and len(x) & (len(x) - 1) == 0
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        apart = sum(int(v).bit_count() for v in x ^ y)
        assert apart <= len(np.setxor1d(a, b))
        assert near_copies.long_sketch(a).tolist() == near_copies.long_sketch(a[::-1]).tolist()


def test_close_pairs_keep_links_of_long_texts_and_drop_chance_pairs(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 9000)]
    near = list(words)
    for at in range(50, 9000, 90):
        near[at] = "changed"
    other = [f"v{i}" for i in rng.integers(0, 10**6, 9000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, width=5, num=80, den=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
