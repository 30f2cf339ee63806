"""Operators that learn, chat formatting, and the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kinespark.llm import chat, decontaminate, language, pii, queries, simhash, toxicity
from tests.conftest import DATA
from tests.llm.test_pairs import classes, plain_fingerprint
from tests.llm.test_scans import ODD, contaminated, odd

SF = f"{DATA}/sf0.01"


def bucket(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_on_held_out_rows(spark):
    got = queries.op2_toxicity(spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    assert (got["held_out"] == [bucket(i, 5) == 0 for i in got.index]).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    both = got.join(labels, how="inner")
    both = both[both["held_out"]]
    assert len(both) > 40 and (both["predicted"] == both["toxic"]).mean() > 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.train(docs, x) for x in (labels, other))
    assert a.learned == b.learned and np.array_equal(a.knots, b.knots) and all(np.array_equal(x, y) for s, t in zip(a.booster.trees, b.booster.trees, strict=True) for x, y in zip(s, t, strict=True))


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for df, given_ in ((odd(spark), labels), (odd(spark), labels.where("false")), (odd(spark).where("false"), labels)):
        model = toxicity.train(df, given_, holdout=None)
        got = toxicity.score(odd(spark), model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert toxicity.score(odd(spark).where("false"), model).count() == 0
    assert toxicity.keep_clean(odd(spark), model).columns == odd(spark).columns


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    b = toxicity.Booster(rounds=60).fit(x, y)
    assert ((b.raw(x) > 0) == y).mean() > 0.97
    raw = rng.normal(size=3000)
    knots, values = toxicity.isotonic(raw, (rng.random(3000) < 1 / (1 + np.exp(-2 * raw))).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert abs(np.interp(0.0, knots, values) - 0.5) < 0.1


def test_language_on_held_out_rows(spark):
    got = queries.op10_language(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    held = got[got["held_out"]]
    assert (got["held_out"] == [bucket(i, 4) == 2 for i in got.index]).all()
    assert (held["lang_pred"] == docs.loc[held.index, "lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "12 34", None), (5, "und die", None), (6, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, holdout=None)
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[5]["lang_pred"] == "de" and got[1]["lang_pred"] == "en"
    none = language.train(df.where("false"))
    assert {r["lang_pred"] for r in language.predict(df, none).collect()} == {"und"}
    assert language.predict(odd(spark), model).count() == len(ODD) and language.predict(df.where("false"), model).count() == 0


def test_grams_do_not_cross_texts():
    one, _ = language._grams(["ab"])
    two, at = language._grams(["ab", "cd"])
    assert two[: at[1]].tolist() == one.tolist()


# --- chat ---

piece = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", ">", "\n", "a", "assistant", "é"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(piece)
def test_escapes_are_undone(t):
    assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def told(rows):
    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("inline", [chat.INLINE_CHARS, 50])
def test_conversations_read_back(spark, inline):
    said = {
        1: [("system", "be <|im_end|>"), ("user", "q"), ("assistant", "a\n<|im_start|>user\nx"), ("user", "more"), ("assistant", ""), ("user", "end")],
        2: [("user", "only")], 3: [("assistant", "first")] * 3, 4: [("user", "u"), ("assistant", "é" * 60), ("user", "v" * 60), ("assistant", "w")],
    }
    rows = [(c, k, r, t, "x") for c, turns in said.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, example string")
    examples = chat.format_conversations(df, inline=inline)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(examples).collect()}
    assert got == {c: told(t) for c, t in said.items()}
    assert examples.where("loss_from is not null").count() == sum(r == "assistant" for t in said.values() for r, _ in t)


def test_an_example_has_all_turns_before_it(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = chat.format_conversations(df).orderBy("example").collect()
    first, second = rows
    assert second["text"].startswith(first["text"]) and second["text"][second["loss_from"] : second["loss_to"]] == "b"
    assert second["text"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nr<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_long_conversations_are_whole(spark):
    """Sizes are those of the SQL and examples have all turns before them, by reference or not."""
    turns = [(c, k, ("user", "assistant")[k % 2], "<|im_end|> é" * (k + c)) for c in range(3) for k in range(9)]
    rows = [*turns, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    want = sorted(con.execute(queries.ORACLE_SQL["op9_chat"]).fetchall())
    whole = sorted(map(tuple, chat.format_conversations(df).collect()))
    short = chat.format_conversations(df, inline=50)
    assert short.where("text_from > 0").count() > 0
    assert sorted(map(tuple, chat.read_back(short).collect())) == want
    assert sorted(map(tuple, chat.read_back(short.orderBy(F.rand(1))).collect())) == want
    with pytest.raises(Exception, match="does not go on"):
        chat.read_back(chat.format_conversations(df).withColumn("text", F.when(F.col("example") == 1, F.regexp_replace("text", "e", "x")).otherwise(F.col("text")))).collect()
    assert sorted(map(tuple, chat.expanded(short).collect())) == sorted(map(tuple, chat.expanded(chat.format_conversations(df)).collect())) == whole


@pytest.mark.parametrize("how", [{}, {"inline": 0}, {"inline": 50}])
def test_examples_have_one_form_at_every_size(spark, how):
    """What an example's text repeats of the turns before is one rule for a short conversation and one of 12.8 million code points."""
    turns = [(c, k, ("user", "assistant")[k % 2], "é<|" * n) for c, n in ((1, 3), (2, 400_000)) for k in range(8)]
    want, whole, end = [], "", 0
    for c, k, role, text in turns:
        if k == 0:
            whole, end = "", 0
        whole += f"<|im_start|>{role}\n{chat.escape(text)}<|im_end|>\n"
        if role == "assistant":
            start = max(end - how["inline"], 0) if how else 0
            to = len(whole) - len("<|im_end|>\n")
            want.append((c, k // 2, k + 1, start, whole[start:], to - len(chat.escape(text)), to))
            end = len(whole)
    df = spark.createDataFrame(turns[::-1], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat.format_conversations(df, **how).collect()))
    assert [(*g[:4], len(g[4]), *g[5:]) for g in got] == [(*w[:4], len(w[4]), *w[5:]) for w in want]
    assert all(g[4] == w[4] for g, w in zip(got, want, strict=True))


def test_the_query_writes_each_turn_once_at_every_size(spark, tmp_path, monkeypatch):
    """op9_chat equals its SQL, and its examples are in proportion to a conversation, be it short, of many turns or of large ones."""
    sizes = {1: (6, 5), 2: (600, 900), 3: (7, 700_000)}  # turns and code points of a turn
    turns = [(c, k, ("user", "assistant")[k % 2], "<|é" * (size // 3)) for c, (n, size) in sizes.items() for k in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen, real = [], chat.read_back
    monkeypatch.setattr(chat, "read_back", lambda examples, **how: seen.append(examples) or real(examples, **how))
    got = sorted(map(tuple, queries.op9_chat(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["op9_chat"]).fetchall())
    stored = seen[0].groupBy("conv_id").agg(F.sum(F.length("text")), F.max(F.col("text_from") + F.length("text"))).collect()
    assert {c for c, _, _ in stored} == {-1, 1, 2, 3} and all(written == size for _, written, size in stored)


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "early"), (None, 0, "assistant", "x"), (2, 1, "user", "t"), (2, 1, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {1: 2, None: 1, 2: 2}
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


# --- pipeline ---


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sf = f"{DATA}/sf0.001"
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {i: t for i, t in rows.items() if model.scores([t])[0] < 0.5}
    fp = {i: plain_fingerprint(t) for i, t in left.items()}
    root = classes(sorted(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    left = {i: t for i, t in left.items() if root[i] == i}
    left = {i: t for i, t in left.items() if not contaminated(t, bench)[1]}
    want = {i: hashlib.sha256(pii.redact(t, pii.spans(t)).encode()).hexdigest() for i, t in left.items()}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf)
            assert df.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == df.count()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    assert decontaminate.WINDOW == 10 and simhash.RADIUS == 4
