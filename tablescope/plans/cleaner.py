"""The cleaning rules as a stage of a ``pyspark.ml`` pipeline: fitted once, saved, applied to other tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from tablescope.functions.tables import small_table
from tablescope.operators.sanitize import CleaningPlan, ColumnPlan, sanitize

#: whole numbers travel as text, since they may not fit a double
_COLUMNS = (
    "position int, name string, real_fill double, whole_fill string, mean double, sd double, origin string, "
    "keeps_type boolean"
)


class _CleanerParams(Params):
    zscoreThreshold = Param(
        Params._dummy(), "zscoreThreshold", "a cell this many deviations off removes its row", TypeConverters.toFloat
    )
    keyCols = Param(Params._dummy(), "keyCols", "columns carried along untouched", TypeConverters.toListString)

    def getZscoreThreshold(self) -> float:
        return self.getOrDefault(self.zscoreThreshold)

    def getKeyCols(self) -> list[str]:
        return self.getOrDefault(self.keyCols)


class TableCleaner(Estimator, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    """``sanitize`` as an estimator. A fill is fitted for every kept column, so the model serves tables with other gaps."""

    minUniqueRatio = Param(
        Params._dummy(), "minUniqueRatio", "least share of distinct values of a kept column", TypeConverters.toFloat
    )
    imputationStrategy = Param(
        Params._dummy(), "imputationStrategy", "median, mean or most_frequent", TypeConverters.toString
    )

    @keyword_only
    def __init__(
        self,
        *,
        zscoreThreshold: float = 3.0,
        minUniqueRatio: float = 0.01,
        imputationStrategy: str = "median",
        keyCols: Sequence[str] = (),
    ):
        super().__init__()
        self._setDefault(zscoreThreshold=3.0, minUniqueRatio=0.01, imputationStrategy="median", keyCols=[])
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(
        self,
        *,
        zscoreThreshold: float = 3.0,
        minUniqueRatio: float = 0.01,
        imputationStrategy: str = "median",
        keyCols: Sequence[str] = (),
    ) -> TableCleaner:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TableCleanerModel:
        fitted = sanitize(
            dataset,
            self.getZscoreThreshold(),
            self.getOrDefault(self.minUniqueRatio),
            self.getOrDefault(self.imputationStrategy),
            key=self.getKeyCols(),
            fill_all=True,
        )
        return self._copyValues(TableCleanerModel(fitted.plan))


class TableCleanerModel(Model, _CleanerParams, MLReadable, MLWritable):
    """A fitted plan: ``transform`` is one projection and one filter, so nothing is shuffled.

    ``zscoreThreshold`` may be set anew on the model; the centres, spreads and fills stay those of the fitted table.
    """

    def __init__(self, plan: CleaningPlan):
        super().__init__()
        self._setDefault(zscoreThreshold=plan.zscore_threshold, keyCols=[])
        self.plan = plan

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return replace(self.plan, zscore_threshold=self.getZscoreThreshold()).apply(dataset, self.getKeyCols())

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader[TableCleanerModel]:
        return _ModelReader()


class _ModelWriter(MLWriter):
    """Params as metadata, the columns' numbers as a small Parquet table beside it."""

    def __init__(self, model: TableCleanerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        plan = self.model.plan
        extra = {"removeOutliers": plan.remove_outliers}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        rows = [
            (
                i,
                c.name,
                c.fill if isinstance(c.fill, float) else None,
                str(c.fill) if isinstance(c.fill, int) else None,
                c.mean,
                c.sd,
                str(c.origin),
                c.keeps_type,
            )
            for i, c in enumerate(plan.columns)
        ]
        small_table(self.sparkSession, rows, _COLUMNS).coalesce(1).write.parquet(f"{path}/columns")


class _ModelReader(MLReader[TableCleanerModel]):
    def load(self, path: str) -> TableCleanerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.schema(_COLUMNS).parquet(f"{path}/columns")
        columns = tuple(
            ColumnPlan(
                r["name"],
                r["real_fill"] if r["whole_fill"] is None else int(r["whole_fill"]),
                r["mean"],
                r["sd"],
                int(r["origin"]),
                r["keeps_type"],
            )
            for r in table.orderBy("position").collect()
        )
        threshold = metadata["defaultParamMap"]["zscoreThreshold"]
        model = TableCleanerModel(CleaningPlan(columns, threshold, metadata["removeOutliers"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
