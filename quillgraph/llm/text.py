"""Small helpers that several text operators share."""

from __future__ import annotations

import os
import re

#: Letters and digits of Unicode's first 592 code points, as character-class bodies. Texts with any other code point
#: take the slower, general pattern.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_DIGITS = "0-9²³¹¼-¾"
#: Code points with the White_Space property.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_LATIN = re.compile("[^\\n\\r\\t -~\\xa1-\\u024f]")


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
