"""Rows that every operator must bear: null, empty, blank, very long and repeated texts, a null id."""

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (5, "x " * 60_000), (None, "a text without an id"), (6, "Ünïcode ß 中文 \U0001f600 a"), (7, "a b c d"), (8, "a b c d")]
