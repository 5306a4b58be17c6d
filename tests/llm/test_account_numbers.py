from isospark.llm import pii

ES, GB, NO, MT = "ES91 2100 0418 4502 0005 1332", "GB29NWBK60161331926819", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"


def test_words_after_account_numbers(spark):
    """An upper-case word or a number behind an account number isn't taken for a part of it."""
    texts = [f"{n}{after}" for n in (ES, GB, NO, MT) for after in (" paid", " USD 50", " 2024", " EUR", "", ".", f" {ES}", f" {GB} NOW")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        text = texts[r.doc_id]
        want = sorted({(text.index(n), text.index(n) + len(n)) for n in (ES, GB, NO, MT) if n in text})
        got = [(s.start, s.stop) for s in r.spans if s.kind == "iban"]
        assert want == [p for p in got if p in want] and len(got) == sum(text.count(n) for n in (ES, GB, NO, MT)), text
    wrong = spark.createDataFrame([(1, ES[:-1] + "3 USD 50"), (2, "x" + ES), (3, ES + "5")], "doc_id long, text string")
    assert not any(s.kind == "iban" for r in pii.find_pii(wrong).collect() for s in r.spans)
