"""Documents with nulls, empty and repeated rows, ties, copies and passages."""

import pytest

from corpus_cases import prose


@pytest.fixture(scope="module")
def rows():
    passage = prose(1, 40)
    out = [(i, prose(100 + i, 60) + "\n" + prose(200 + i, 20)) for i in range(12)]
    out += [(20, prose(5, 90)), (21, prose(5, 90)), (22, prose(5, 90) + " one more"), (23, prose(5, 89))]
    out += [(30, "x y " + passage + " z"), (31, prose(9, 30) + " " + passage + " " + passage), (40, "ab ab ab " * 40)]
    out += [(50, None), (51, ""), (52, "  \n \n"), (53, "one two"), (54, "one two"), (None, prose(5, 90)), (None, None)]
    out += [(60, prose(77, 50)), (60, prose(77, 50)), (61, prose(88, 3000))]
    return out
