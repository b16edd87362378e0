DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(texts, source="a", start=0):
    return [(start + i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)], DOC
