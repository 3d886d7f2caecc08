"""MLlib transformers around the operators, so a fitted pipeline carries its feature steps when saved."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from gearwatch import schemas as S
from gearwatch.functions import tiers
from gearwatch.operators import series


class SensorFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """E1-E4 as a pipeline stage."""

    sensors = Param(Params._dummy(), "sensors", "sensor columns", TypeConverters.toListString)
    order = Param(Params._dummy(), "order", "columns that order the readings of a machine", TypeConverters.toListString)
    key = Param(Params._dummy(), "key", "columns that identify a machine", TypeConverters.toListString)

    @keyword_only
    def __init__(self, sensors=None, order=None, key=None):
        super().__init__()
        self._setDefault(sensors=S.SENSORS, order=["datetime"], key=["machineID"])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return series.sensor_features(dataset, self.getOrDefault("sensors"), self.getOrDefault("key"), self.getOrDefault("order"))


class Float32(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """B10 as a pipeline stage."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return tiers.to_float32(dataset)
