from pii_spark.llm import lines


def rows(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in df.collect()}


def corpus(spark):
    shared = [(i, f"own {i}\n  menu \n\nmore {i}\n", f"site{i}", "z") for i in range(4)]
    extra = [
        (10, "menu\nmenu", "site0", "z"), (11, None, None, "z"), (12, "", "site1", "z"), (13, "own a\nown b", None, "z"),
        (14, "same\nleft\nright", "one", "z"), (15, "same\nup\ndown", "one", "z"), (16, "menu\na\nmenu", None, "z"),
    ]
    return spark.createDataFrame([*shared, *extra], "doc_id long, text string, source string, _hits string")


def test_lines_on_many_sites_go(spark):
    got = rows(lines.remove_spread_lines(corpus(spark), min_sites=3))
    assert got[2] == ("own 2\n\nmore 2\n", 3, 1)
    assert got[10] == ("menu\nmenu", 2, 0)
    assert got[11] == (None, 0, 0) and got[12] == ("", 0, 0)
    assert got[13][2] == 0 and got[14][2] == 0
    assert got[16] == ("menu\na\nmenu", 3, 0)
    whole = rows(lines.remove_spread_lines(corpus(spark), min_sites=3, max_share=1.0))
    assert whole[10] == ("", 2, 2) and whole[16] == ("a", 3, 2)


def test_sketches_decide_far_lines_and_counts_near_ones(spark):
    data = [(i, f"far\nnear\nbelow\nx{i}\ny{i}\nz{i}", f"s{i}" if i < 400 else "t") for i in range(500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    spread = lines.spread_lines(lines.document_lines(df), 100)
    assert spread.count() == 3
    assert lines.spread_lines(lines.document_lines(df), 401).count() == 3
    assert lines.spread_lines(lines.document_lines(df), 402).count() == 0


def test_native_plan_and_empty_table(spark):
    df = lines.remove_spread_lines(corpus(spark), min_sites=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert lines.remove_spread_lines(corpus(spark).limit(0)).count() == 0


def test_columns_pass_through(spark):
    got = lines.remove_spread_lines(corpus(spark), min_sites=3)
    assert got.columns == ["doc_id", "source", "_hits", "text", "n_lines", "n_removed"]
