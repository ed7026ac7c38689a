import pytest

from threadtox.operators import annotations as A
from threadtox.session import scratch_path
from threadtox.sources import files

SCHEMA = "id long, tox_codes_oc array<string>, tox_codes_ic array<string>, tox_codes_parent array<string>, workers_ic array<long>"
T, V, N = "TOXIC", "VERY TOXIC", "NON-TOXIC"


def corpus(spark):
    return spark.createDataFrame([
        (1, [N, N], [T, V, N], [T, T], [7, 8, 9]), (2, [N, T], [N, T], [N, T], [7, 8]), (3, [N], [N, N], None, [9, 9]), (4, [T], None, [N], [7]),
        (5, [], [T], [], None), (None, [N], [T, T, N], [N, N, T], [8, None]), (1, [N, N], [T, V, N], [T, T], [7, 8, 9])], SCHEMA)


def test_votes_by_annotator(spark):
    got = {r.worker: (r.n_posts, r.n_toxic, r.rate, r.agreement) for r in A.annotator_votes(corpus(spark)).collect()}
    # 7: posts 1, 1 (toxic, with the majority) and 2 (a tie); 8: 1, 1, 2 and the post without id; 9: 1, 1 against, 3 twice with
    assert got == {7: (3, 2, pytest.approx(2 / 3), 1.0), 8: (4, 4, 1.0, 1.0), 9: (4, 0, 0.0, 0.5)}
    assert A.annotator_votes(corpus(spark).limit(0)).count() == 0


def test_context_effect_by_the_parents_toxicity(spark):
    got = {r.parent: (r.n, r.rate_oc, r.rate_ic, r.n_sensitive) for r in A.parent_effect(corpus(spark)).collect()}
    assert got["toxic"] == (3, pytest.approx(0.5 / 3), pytest.approx((2 / 3 * 2 + 0.5) / 3), 2)
    assert got["none"][0] == 2 and got["other"][0] == 2 and A.parent_effect(corpus(spark).limit(0)).count() == 0


def test_lists_in_csv_fields(spark):
    df = spark.createDataFrame([("['NON-TOXIC', 'VERY TOXIC']",), ('["a", "it\'s"]',), ("[]",), (None,), ("[1,2 ,  30]",), ("",)], "x string")
    got = [r.y for r in df.select(files.parse_list(df.x).alias("y")).collect()]
    assert got == [["NON-TOXIC", "VERY TOXIC"], ["a", "it's"], [], None, ["1", "2", "30"], []]
    path = scratch_path(spark, "t-annotations")
    rows = spark.createDataFrame([(1, [N, V], 'a "text"\nof two, lines', 2, None, [T], None, [3, 4]), (2, [], "x", 0, "p", [], [N], [])],
                                 "id long, tox_codes_oc array<string>, text string, toxicity_annotator_count int, parent string, tox_codes_ic array<string>, "
                                 "tox_codes_parent array<string>, workers_ic array<long>")
    files.write_annotations_csv(rows, path)
    assert sorted(map(tuple, files.read_annotations_csv(spark, path).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
