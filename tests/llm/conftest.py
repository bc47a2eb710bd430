from __future__ import annotations

import pytest

#: Rows with every trouble: nulls, white space, equal texts, repeated rows, a very long text.
LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(30_000))
ROWS = [
    (1, "a b  c d e f g h", "src2"),
    (2, "a b c\td e f g h", "src2"),
    (3, "a b c d e f g i", "src1"),
    (4, None, "src1"),
    (5, "", None),
    (6, " ", None),
    (7, "   ", "src3"),
    (8, LONG, "src3"),
    (9, LONG, "src2"),
    (10, LONG + " tail", "src2"),
    (None, "no id here at all", None),
    (None, "no id here at all", None),
    (11, "x", "src1"),
    (11, "x", "src1"),
    (12, "A B C D E F G H", "src2"),
    (13, "naïve “quoted” ΑΣΣ 日本語   é <|endoftext|> it's 12 $$", "src4"),
]
#: Columns whose names an operator might use itself.
EXTRA = "size int, _row int, _n string, _text string, _c1 int, score string, target int, _group int, position int, host string, KEEP_ID int, _set string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.fixture
def clashing(spark):
    extra = (1, 2, "n", "t", 3, "s", 4, 5, 6, "h", 7, "z")
    return spark.createDataFrame([(*r, *extra) for r in ROWS], "doc_id long, text string, source string, " + EXTRA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
