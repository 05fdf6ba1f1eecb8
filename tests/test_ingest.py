"""L1 cleaning rules, golden cases."""

from recoflow.operators import ingest
from recoflow.sources import files


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def rows(df):
    return sorted((r["msisdn"], r["package"]) for r in df.collect())


def test_sample_lines_round_trip(spark, tmp_dir):
    path = f"{tmp_dir}/raw.txt"
    with open(path, "w") as f:
        f.write("84300000007,AB1,Big20,Day5\n84300000008,AB1,Big30,Day6\n")
    out = ingest.standardize_subscribers(files.read_raw_lines(spark, path))
    assert rows(out) == [(84300000007, "AB1"), (84300000007, "Big20"), (84300000007, "Day5"),
                         (84300000008, "AB1"), (84300000008, "Big30"), (84300000008, "Day6")]


def test_msisdn_prefix_rewrite_first_occurrence_only(spark):
    out = ingest.standardize_subscribers(lines_df(spark, ["84168416123,A", "84312345678,B", "9998416,C"]))
    assert rows(out) == [(9998416, "C"), (8438416123, "A"), (84312345678, "B")]


def test_brand_tokens_removed_in_order(spark):
    out = ingest.standardize_subscribers(lines_df(spark, ["1,MOBILE-X", "2,MOBILE- X", "3,MOBILE_X", "4,AMOBILE-BMOBILE_C"]))
    assert rows(out) == [(1, "X"), (2, " X"), (3, "X"), (4, "ABC")]


def test_filtered_prefixes_and_empty_lists(spark):
    out = ingest.standardize_subscribers(lines_df(spark, [
        "1,PCRF1,HOME2,MONG3,MUONG4",    # every offer dropped -> user dropped
        "2,MOBILE_PCRF9,KEEP",           # brand token removed before the prefix filter
        "3,A,,",                         # empty offers from trailing commas are dropped
        "4",                             # no offers at all
    ]))
    assert rows(out) == [(2, "KEEP"), (3, "A")]


def test_non_numeric_msisdn_becomes_null(spark):
    out = ingest.standardize_subscribers(lines_df(spark, ["abc,A"]))
    assert rows(out) == [(None, "A")]
