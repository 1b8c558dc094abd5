"""The parser as a DataFrame operator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .kernel import FIELD, Gazetteer, Options, Parser
from .scoring import Resources, scorer

#: A gazetteer is a national list of places: beyond so many rows something else was passed.
MOST_LOCATIONS = 200_000

SPAN = "array<struct<label:string,text:string,canonical:string,start:int,end:int,confidence:double>>"
SUMMARY = ", ".join(f"{f} string" for f in FIELD.values()) + f", spans {SPAN}, confidence double, abstentions array<struct<field:string,reason:string>>, candidates_evaluated int, hypotheses_evaluated int"
FULL = ", trace array<struct<label:string,text:string,canonical:string,start:int,end:int,evidenceScore:double,latentScore:double,score:double,source:string,evidence:array<struct<ruleId:string,effect:string,value:double>>,outcome:string,reason:string>>, rejections array<struct<label:string,text:string,start:int,end:int,ruleId:string>>"
_parsers: dict[str, Parser] = {}


class AddressEngine:
    """engine = AddressEngine(gazetteer_df); engine.parse(messages) adds the seven fields, spans, confidence, abstentions and counts.

    The gazetteer (subdistrict, district, province, zipcode, and location_id for the order) is a dimension: its size is checked and it is
    broadcast once. Parsing is a narrow step, so it also runs on streaming frames.
    """

    def __init__(self, gazetteer: DataFrame, resources: Resources | None = None, options: Options | None = None):
        spark = gazetteer.sparkSession
        rows = gazetteer.orderBy("location_id").limit(MOST_LOCATIONS + 1).collect() if "location_id" in gazetteer.columns else gazetteer.limit(MOST_LOCATIONS + 1).collect()
        if len(rows) > MOST_LOCATIONS:
            raise ValueError(f"a gazetteer has at most {MOST_LOCATIONS} rows")
        places = [{c: r[c] for c in ("subdistrict", "district", "province", "zipcode")} for r in rows]
        self.options, self.resources = options or Options(), resources
        self.key, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast((places, resources, self.options))

    def parse(self, messages: DataFrame, raw: str = "raw") -> DataFrame:
        held, key = self.held, self.key
        added = T._parse_datatype_string(SUMMARY + FULL * (self.options.diagnostics == "full"))
        schema = T.StructType([*messages.schema.fields, *added.fields])
        arrow, at = to_arrow_schema(added), messages.columns.index(raw)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _parsers:
                places, resources, options = held.value
                _parsers.clear()
                _parsers[key] = Parser(Gazetteer(places), options, scorer(resources) if resources else None)
            parse = _parsers[key].parse
            for batch in batches:
                found = pa.RecordBatch.from_pylist([parse(x or "") for x in batch.column(at).to_pylist()], schema=arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], names=schema.names)

        return self._spread(messages).mapInArrow(run, schema)

    @staticmethod
    def _spread(messages: DataFrame) -> DataFrame:
        """Parsing costs far more than moving a message, so a frame in fewer partitions than there are cores is dealt out; a larger one stays where it is."""
        if messages.isStreaming:
            return messages
        cores = messages.sparkSession.sparkContext.defaultParallelism
        return messages if messages.rdd.getNumPartitions() >= cores else messages.repartition(2 * cores)


def to_utf16(raw: F.Column, at: F.Column) -> F.Column:
    """A code-point offset in UTF-16 units, the unit of the data contract."""
    return F.when(at <= 0, 0).otherwise((F.length(F.encode(F.substring(raw, F.lit(1), at), "UTF-16BE")) / 2).cast("int"))
