from pyspark.sql import functions as F

from fieldspark.llm import chat


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).repartition(3)
    out = chat.format_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()
    return {r.pair_id: r for r in out}


def test_prompt_is_the_longest_common_prefix(spark):
    shared = [(0, "system", "be kind"), (1, "user", "hi")]
    rows = [(c, *t) for c in (4, 5) for t in shared] + [(4, 2, "assistant", "hello"), (5, 2, "assistant", "go away"), (5, 3, "user", "ok")]
    r = formatted(spark, rows)[2]
    assert r.prompt == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert (r.n_prompt, r.n_chosen, r.n_rejected) == (2, 1, 2)
    assert [tuple(s) for s in r.chosen] == [("<|im_start|>assistant\n", 0), ("hello<|im_end|>\n", 1)]
    assert [s.loss for s in r.rejected] == [0, 1, 0, 0]


def test_odd_rows(spark):
    rows = [(0, 0, None, None), (1, 0, None, None), (1, 1, "assistant", None), (6, 0, "user", "alone"), (None, 0, "user", "x"), (8, 0, "user", "a"), (8, 0, "user", "a"), (9, 0, "user", "a"), (10, 0, "user", None), (11, 0, "user", "")]
    got = formatted(spark, rows)
    assert set(got) == {0, 3, 4, 5}
    assert (got[0].n_prompt, got[0].n_chosen, got[0].n_rejected) == (1, 0, 1)
    assert (got[3].n_prompt, got[3].prompt, got[3].n_chosen, got[3].rejected) == (0, "", 1, [])
    assert (got[4].n_prompt, got[4].n_chosen, got[4].n_rejected) == (1, 1, 0)
    assert got[5].n_prompt == 0


def test_empty_table(spark):
    assert formatted(spark, []) == {}
