import pyarrow as pa
import pytest

from helixframe.llm import bytescan, near_dedup


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four", "one two three four five"])
def test_short_text_alone_in_its_part(text):
    h, counts = near_dedup.shingles(bytescan.Texts(pa.array([text])), 5)
    assert counts.tolist() == [1]
    both, each = near_dedup.shingles(bytescan.Texts(pa.array([text, "six other words are here too"])), 5)
    assert each.tolist() == [1, 2] and both[0] == h[0]
