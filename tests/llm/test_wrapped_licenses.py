import textwrap

from palimpsest.llm import licenses


def test_wrapped_with_and_without_titles(spark):
    texts = []
    for name in ("MIT", "ISC", "0BSD", "Zlib"):
        body = dict(licenses.KNOWN)[name].removeprefix("MIT License")
        for title in ["", *licenses.TITLES[name]]:
            for width in (None, *range(40, 100, 3)):
                paragraphs = [p if width is None else "\n".join(textwrap.wrap(p, width)) for p in body.strip().split("\n\n")]
                texts.append((name, "\n\n".join([title, "Copyright (c) 2020 A. Holder\nCopyright Some Body\nAll rights reserved.", *paragraphs])))
    df = spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(texts))] == [n for n, _ in texts]
