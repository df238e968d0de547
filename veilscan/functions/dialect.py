"""Character classes that mean in Java what they mean in Python ``re``.

Java's plain ``\\w``, ``\\d``, ``\\s`` are ASCII and its ``\\b`` changed between
JDK releases, so every pattern of the library spells its classes out. The
strings below are class *contents*: put them inside ``[...]``.
"""

SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = r"\p{L}\p{N}_"

DIGIT = r"\p{Nd}"
WORD_START = rf"(?<![{WORD}])"  # \b before a word character
WORD_END = rf"(?![{WORD}])"  # \b after a word character
