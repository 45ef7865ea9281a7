"""Plain helpers of the brute-force versions."""

import re
import zlib

BRUTE_WINDOW = 50
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(_LOWER)) if w]


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
