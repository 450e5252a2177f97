import random

from rillwatch.llm import chat

SCHEMA = "pair_id long, turn long, role string, text string, side string, prompt string"


def plain(chosen, rejected):
    """Pairs by plain loops over {id: [(role, text), ...]}."""
    def line(t):
        return f"<|im_start|>{t[0]}\n{t[1]}<|im_end|>\n"

    def spans(turns):
        at, out = 0, []
        for t in turns:
            if t[0] == "assistant":
                start = at + len("<|im_start|>assistant\n")
                out.append((start, start + len(t[1]) + len("<|im_end|>")))
            at += len(line(t))
        return out

    for i in sorted(chosen.keys() | rejected.keys()):
        c, r = chosen.get(i, []), rejected.get(i, [])
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        yield (i, len(c), len(r), n, "".join(map(line, c[:n])), "".join(map(line, c[n:])), spans(c[n:]), "".join(map(line, r[n:])), spans(r[n:]))


def agree(spark, chosen, rejected):
    def table(side):
        rows = [(i, k, *t, "x", "clash") for i, turns in side.items() for k, t in enumerate(turns)]
        return spark.createDataFrame(rows, SCHEMA)

    got = chat.format_preferences(table(chosen), table(rejected)).orderBy("pair_id").collect()
    found = [(*r[:6], [tuple(s) for s in r.chosen_mask], r.rejected, [tuple(s) for s in r.rejected_mask]) for r in got]
    assert found == list(plain(chosen, rejected))


def test_random_pairs(spark):
    rng = random.Random(1)
    turn = lambda: (rng.choice(["user", "assistant", "system"]), rng.choice(["", "hi", "né🙂", "a\nb", "<|im_end|>"]))
    chosen, rejected = {}, {}
    for i in range(150):
        base = [turn() for _ in range(rng.randint(0, 5))]
        chosen[i], rejected[i] = base + [turn() for _ in range(rng.randint(0, 3))], base + [turn() for _ in range(rng.randint(0, 3))]
    agree(spark, {k: v for k, v in chosen.items() if v}, {k: v for k, v in rejected.items() if v})


def test_long_conversation(spark):
    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(1500)]
    agree(spark, {1: turns}, {1: [*turns[:-1], ("user", "z")]})


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "q", "", ""), (1, 0, "user", "q", "", ""), (1, 1, None, None, "", ""), (1, 1, "assistant", "b", "", ""),
            (1, None, "system", "s", "", ""), (None, 0, "user", "lost", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    row, = chat.format_preferences(df, df.filter("role is not null")).collect()
    assert (row.n_chosen, row.n_rejected, row.n_prefix) == (4, 3, 2)
    assert row.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert row.chosen == "<|im_start|>\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert chat.format_preferences(df.limit(0), df.limit(0)).count() == 0


def test_swapped_answers(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (2, 2, "user", "bye"),
            (3, 0, "user", "q3"), (4, 0, "user", "q4"), (4, 1, "assistant", "a4"), (5, 0, "assistant", None), (None, 1, "assistant", "x")]
    chosen, rejected = chat.swapped_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, chosen.collect())) == [(2, 0, "user", "q2"), (2, 1, "assistant", "a2"), (2, 2, "user", "bye")]
    assert sorted(map(tuple, rejected.collect())) == [(2, 0, "user", "q2"), (2, 1, "assistant", "a1"), (2, 2, "user", "bye")]


def test_query_takes_a_null_answer_as_empty_like_its_sql(spark, tmp_path):
    import duckdb

    from rillwatch.llm import queries

    rows = [(4, 0, "user", "q4"), (4, 1, "assistant", "a4"), (5, 0, "user", "q5"), (5, 1, "assistant", None), (6, 0, "user", None), (6, 1, "assistant", "a6"),
            (8, 0, "assistant", "a8")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.op1_preference_pairs(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert [r[0] for r in got] == [5, 6]
    assert got == sorted(db.sql(queries.ORACLES["op1_preference_pairs"]).fetchall())
