import pytest
from pyspark.sql import functions as F

from cueforge.functions import prosody
from cueforge.operators.synthesize import resolve
from cueforge.sources import voices

CASES = [
    ("Hello<emotion:happy>world", [("emotion", "happy")], "Helloworld", 195, None),
    ("<rate:100>text", [("rate", "100")], "text", 100, None),
    ("<emotion: happy>text", [], "<emotion: happy>text", None, None),
    ("<b>bold</b>", [], "<b>bold</b>", None, None),
    ("<rate:x-slow>hi", [], "<rate:x-slow>hi", None, None),
    ("<rate:200><rate:²>x", [("rate", "200"), ("rate", "²")], "x", 200, None),
    ("<emotion:excited><rate:fast>x", [("emotion", "excited"), ("rate", "fast")], "x", 220, None),
    ("<emotion:calm><pitch:low>x", [("emotion", "calm"), ("pitch", "low")], "x", 150, 38),
    ("<Rate:SLOW><pitch:200>x", [("Rate", "SLOW"), ("pitch", "200")], "x", 130, 100),
    ("<rate:9><émotion:ü>x", [("rate", "9"), ("émotion", "ü")], "x", 20, None),
]


def test_tags_and_resolution(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    rows = rows.select("i", prosody.tags(F.col("raw")).alias("tags"), prosody.clean(F.col("raw")).alias("text"))
    for r in resolve(rows).collect():
        _, tags, clean, rate, pitch = CASES[r.i]
        assert ([tuple(t) for t in r.tags] if tags or r.tags else [], r.text, r.rate, r.pitch) == (tags, clean, rate, pitch)
        assert r.spoken == (f"[[ pbas {pitch} ]] {clean}" if pitch is not None else clean)


@pytest.mark.parametrize("bounds,pairs", [(prosody.RATE_BOUNDS, [(0, 20), (19, 20), (20, 20), (500, 500), (501, 500), (None, None)]), (prosody.PITCH_BOUNDS, [(-101, -100), (101, 100), (0, 0), (None, None)])])
def test_clamp(spark, bounds, pairs):
    rows = spark.createDataFrame(pairs, "x bigint, want bigint").select(prosody.clamp(F.col("x"), bounds).alias("got"), "want")
    assert all(r.got == r.want for r in rows.collect())


def test_voices(spark):
    listing = ["Albert              en_US    # Hello", "Daniel  en_GB # Hi", "Mónica   es_ES   # Hola", "Paulina  es_MX # Hola", "Thomas   fr_FR    # Bonjour", "no voice here"]
    known = voices.parse_catalogue(spark.createDataFrame(list(enumerate(listing)), "pos int, line string"))
    assert known.count() == 5 and voices.base_languages(known).first().languages == "en, es, fr"
    want = {"": None, "es": "Mónica", "es-MX": "Paulina", "en_GB": "Daniel", "FR": "Thomas", "xx": None}
    rows = spark.createDataFrame([(k,) for k in want], "language string")
    assert {r.language: r.voice for r in voices.select_voices(rows, known).collect()} == want
    with pytest.raises(Exception, match="no voice for language xx"):
        voices.select_voices(rows, known, strict=True).collect()
