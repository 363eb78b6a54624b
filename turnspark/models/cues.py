"""The text cues as a ``pyspark.ml`` stage that can be saved and reloaded within a Pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnspark.functions.text import ENDPOINT_NAMES, endpoint_features


class CueTransformer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the cue columns of ``inputCol`` as one vector, in the order of ENDPOINT_NAMES.

    Column expressions alone, so that the stage joins the scan's codegen; a null text has the
    cues of an empty one. All other columns stay as they are.
    """

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "cues"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="cues")
        self._set(**self._input_kwargs)

    def transformSchema(self, schema: StructType) -> StructType:
        from pyspark.ml.linalg import VectorUDT

        if self.getInputCol() not in schema.names:
            raise ValueError(f"no column {self.getInputCol()}")
        if self.getOutputCol() in schema.names:
            raise ValueError(f"column {self.getOutputCol()} is there already")
        return StructType([*schema.fields]).add(self.getOutputCol(), VectorUDT())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        text = F.col(f"`{self.getInputCol()}`")
        values = F.array(*[c.cast("double") for c in endpoint_features(text)])
        return dataset.withColumn(self.getOutputCol(), array_to_vector(values))

    @staticmethod
    def names() -> list[str]:
        return list(ENDPOINT_NAMES)
