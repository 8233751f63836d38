"""Display phrases of whole texts in Hindi and Hinglish."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import lookups as L
from tallyforge.operators import language as LG


def test_phrases_then_words(spark):
    texts = ["Recommended action: Assign an owner. High revenue_risk", "Quick Win", "", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r for r in table.select("id", *[LG.localize_text(F.col("text"), c).alias(c) for c in ("hi", "hinglish", "en")]).collect()}
    assert got[0].hi.startswith("सुझाई गई कार्रवाई: जिम्मेदार व्यक्ति तय करें. उच्च ") and "_" not in got[0].hi
    assert got[1].hi == "त्वरित लाभ" and got[1].hinglish == "Quick win"
    assert got[2].hi == got[2].hinglish == got[2].en == "" and got[3].hi is None


def test_each_list_keeps_its_kind():
    """Phrases of texts are pairs in order, phrases of findings a table; one must not hide the other."""
    assert all(isinstance(p, tuple) and len(p) == 2 for terms in L.DISPLAY_PHRASES.values() for p in terms)
    assert all(isinstance(terms, dict) for terms in L.PHRASES.values())
