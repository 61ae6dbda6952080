"""Queries of the advert texts: documents with an advert's sentence in front."""

from __future__ import annotations

from pyspark.sql import functions as F

from advertlake.functions import advert_text as A
from advertlake.session import table

_SAID = ["Acil satılık, ufak masrafı var", "TR plakalı, evrakları tam", "pert kaydı yok, sol direksiyon", "AĞIR HASARLI, sağ direksiyon", "gümrük ödendi, 180 hp", "aracın masrafları vardır", "satıldı İlan No: 12345", "temiz araç"]


def _texts(spark, d):
    said = F.element_at(F.array(*[F.lit(s) for s in _SAID]), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(said, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")).withColumn("low", A.lowered(F.col("text")))


def flags(spark, d):
    t, low = F.col("text"), F.col("low")
    return _texts(spark, d).select("doc_id", F.array_join(A.scan(t, A.WARNING, low), ",").alias("warnings"), F.array_join(A.scan(t, A.PLATE, low), ",").alias("plate"), A.customs_stated(t, low).alias("customs"))


def traps(spark, d):
    t, low = F.col("text"), F.col("low")
    return _texts(spark, d).select("doc_id", F.array_join(A.scan(t, A.BLOCKING, low), ",").alias("blocking"), F.array_join(A.scan(t, A.URGENCY, low), ",").alias("urgency"),
                                   A.cost_unknown(t, low).alias("cost_unknown"), A.steering(t, low).alias("steering"), A.sold_number(t, low).alias("sold_number"))


QUERIES = {"TX45_TX48_TX49_warnings": flags, "TX44_TX46_TX47_TX42_TX28_traps": traps}
_X = "lower(translate(text, 'İI', 'iı'))"
_CASE = lambda table: "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_X}, '{p}') THEN '{n}' END" for n, p in table.items()) + ")"
ORACLE_SQL = {
    "TX45_TX48_TX49_warnings": f"""WITH t AS (SELECT doc_id, {_SAID}[doc_id % {len(_SAID)} + 1] || chr(10) || coalesce(text, '') AS text FROM documents)
SELECT doc_id, {_CASE(A.WARNING)} AS warnings, {_CASE(A.PLATE)} AS plate, regexp_matches({_X}, '{A.CUSTOMS_OK}') AS customs FROM t""",
}
