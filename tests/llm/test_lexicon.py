"""The lexicon of spam pages counts every document, whatever sample the trees are fitted on."""

from weftlog.llm import spam


def test_lexicon_does_not_depend_on_the_sample(spark, monkeypatch):
    speech = "The captain never sold the torn map to our neighbour. Nobody wanted the last letter.\n" * 4
    docs = [(i, speech, "h") for i in range(300)] + [(i, f"#tag{i} #more lingri #sale bafasko http://x.example/{i} venfa " * 6, "h") for i in range(300, 330)]
    docs += [(1000, "#zweig #laub hubarken #ast #baum hubarken http://y.example/1 hubarken " * 6, "h")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    seen, grow = [], spam.spam_lexicon
    monkeypatch.setattr(spam, "spam_lexicon", lambda *a, **k: seen.append(grow(*a, **k)) or seen[-1])
    for sample_rows in (1000, 33):
        spam.spam_pages(rows, sample_rows=sample_rows)
    assert seen[0] == seen[1] and seen[0]["hubarken"] > 0
