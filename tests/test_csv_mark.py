import glob

from emberday.operators.quality import head_rows
from emberday.sources.sinks import write_csv


def test_mark_in_front_of_the_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "맑음"), (2, None)], "a int, b string").coalesce(1)
    for mark, start in ((True, b"\xef\xbb\xbfa,b\n"), (False, b"a,b\n")):
        write_csv(df, str(tmp_path / str(mark)), mark)
        (part,) = glob.glob(str(tmp_path / str(mark) / "*.csv"))
        with open(part, "rb") as f:
            assert f.read().startswith(start)
    assert head_rows(df, 1).count() == 1 and head_rows(df).count() == 2
