import zlib

from basalt.functions import bytes as B


def test_adler_in_closed_form():
    for data in (b"", b"a", bytes(range(256)) * 300):
        assert B.adler32(data) == zlib.adler32(data)


def test_xor_and_entropy_and_lags():
    assert B.xor_repeating(B.xor_repeating(b"payload", b"key", 5), b"key", 5) == b"payload"
    assert B.xor_repeating(b"x", b"") == b"x"
    assert B.entropy(b"") == 0 and B.entropy(bytes(range(256))) == 8
    assert B.coincidence(b"abab", 2) == (2, 2) and B.coincidence(b"a", 2) == (0, 0)
