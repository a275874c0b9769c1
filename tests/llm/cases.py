"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"word{i % 977} of a very long text{i}" for i in range(6000))
EDGE_TEXTS = ["", " ", "\n", "\n\n \t\n", "a", "x" * 5000, " " * 300, "  two  spaces ", "it's we'll", "tail \n"]

ROWS = [
    (1, "Plain text of a few words."),
    (2, ""),
    (3, None),
    (4, LONG),
    (5, "same text in two documents, which are equal in every word of it"),
    (6, "same text in two documents, which are equal in every word of it"),
    (7, "a repeated row"),
    (7, "a repeated row"),
    (None, "a row without an id"),
    (8, " \n\t "),
    (9, "one"),
]


def documents_of(spark, rows=None):
    """(doc_id, text) and columns whose names operators use inside."""
    data = [(d, t, "x", 0, True, 1.0, "n", 7, None) for d, t in (ROWS if rows is None else rows)]
    names = "doc_id long, text string, node string, n long, kept boolean, score double, line string, component long, spans string"
    return spark.createDataFrame(data, names).repartition(3)
