"""Keys of any type, nulls among them, come back as they are."""

from __future__ import annotations

import public_tokenizers
import pytest

from tequant.llm import pieces, urls
from tequant.llm.queries import URL_RULES


@pytest.mark.parametrize("kind, keys", [("string", ["a", "7", None]), ("int", [1, 2, None]), ("long", [1 << 40, 2, None])])
def test_pieces(spark, kind, keys):
    path = public_tokenizers.path("piece_bpe_32k.model")
    said = ["one text", "", None]
    docs = spark.createDataFrame(list(zip(keys, said, strict=True)), f"doc_id {kind}, text string")
    ids = pieces.encode(docs, path)
    assert ids.schema["doc_id"].dataType.simpleString() == docs.schema["doc_id"].dataType.simpleString()
    assert {(r.doc_id, r.text) for r in pieces.decode(ids, path).collect()} == {(k, t or "") for k, t in zip(keys, said, strict=True)}
    assert {(r.doc_id, r.round_trip) for r in pieces.round_trip(docs, path).collect()} == {(k, True) for k in keys}
    assert pieces.decode(spark.createDataFrame([("x", None)], "doc_id string, ids array<int>"), path).first().text is None


def test_urls_by_join(spark):
    """Repeated rows and urls, keys that are texts or null."""
    rows = [(k, u) for k in ("p", "p", None) for u in ("http://a.com/de/x", "http://a.com/de/x", "http://b.org", None, "")]
    pages = spark.createDataFrame(rows, "page_id string, url string")
    both = [sorted(map(repr, urls.judge(pages, URL_RULES, key="page_id", bound=b).collect())) for b in (0, urls.RULES_BOUND)]
    assert both[0] == both[1] and len(both[0]) == len(rows)
