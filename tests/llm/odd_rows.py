"""Rows that every operator of documents must take."""

LONG = "lorem ipsum dolor sit amet " * 6000
PASSAGE = " ".join(f"word{i}x" for i in range(70))
DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, shard int, class int, grp int, text_key int, score string"


def doc_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, extra clashing columns."""
    texts = [None, "", " \n\t", "...", "one", "One two", "one two three four five six seven", LONG, LONG + " end",
             PASSAGE, "before it " + PASSAGE + " and after it", PASSAGE, "żółw 漢字 🙂 naïve", "12 34 56"]
    rows = [(i, t, "en" if i % 2 else None, None, None, "r", 1, 2, 3, 4, "s") for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], rows[0], (None, "a null id here", None, "x", 3, None, None, None, None, None, None)]
