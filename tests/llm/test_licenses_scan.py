from quillon.llm import licenses


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_texts_are_cut_once_and_not_searched_for_each_word(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    got = plan(licenses.windows(docs, licenses.DICE, licenses.TEMPLATES, licenses.full_texts()))
    assert "contains(lower(" not in got.replace("array_contains", "") and "arrays_overlap" in got


def test_whole_texts_lines_and_windows(spark):
    mit, cc = "Released under the MIT License", "Licensed under CC BY-NC 4.0"
    isc = dict(licenses.full_texts())["ISC"]
    rows = [(1, mit), (2, f"{mit}\n"), (3, f"x\n{cc}\ny z"), (4, None), (5, ""), (None, mit), (6, "pad " * 50 + isc.upper()), (7, isc.replace("software", "softwares"))]
    got = sorted((tuple(r)[:3] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [r for r in got if r[0] in (None, 1, 2)] == [(1, 0, "MIT"), (2, -1, "MIT"), (2, 0, "MIT"), (None, 0, "MIT")]
    assert (3, 1, "CC-BY-NC-4.0") in got and not [r for r in got if r[0] in (4, 5)]
    assert {r[2] for r in got if r[0] == 6} == {"ISC"} and all(r[1] <= -2 for r in got if r[0] == 6)
    assert "ISC" in {r[2] for r in got if r[0] == 7}
