"""Detection from SQL: table functions over partitions and scalar penalty functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from . import penalty


def _split(value: str | None) -> list[str]:
    return [c.strip() for c in (value or "").split(",") if c.strip()]


def _options(given: dict) -> dict:
    """Named arguments as options of ``Spec``: numbers where a criterion or an order was written as text."""
    out = {k: v for k, v in given.items() if v is not None}
    if isinstance(out.get("beta"), str):
        try:
            out["beta"] = float(out["beta"])
        except ValueError:
            pass
    if "beta" in out and not isinstance(out["beta"], str):
        out["beta"] = float(out["beta"])
    if "order" in out:
        out["order"] = tuple(int(v) for v in (_split(out["order"]) if isinstance(out["order"], str) else [out["order"]]))
    return {k: float(v) if k in ("trim", "pruning_coef", "lasso_alpha", "gamma", "vanilla_percentage") and not isinstance(v, str) else v for k, v in out.items()}


def _columns(x: np.ndarray, spec, responses: int) -> np.ndarray:
    """What ``Spec.solve`` takes: lagged rows of autoregressions, ranks."""
    if spec.family in ("ar", "var"):
        past = [x[spec.lag - k : len(x) - k, :responses] for k in range(1, spec.lag + 1)]
        return np.column_stack([x[spec.lag :, :responses], *past])
    if spec.family == "rank":
        return np.argsort(np.argsort(x, 0, kind="stable"), 0, kind="stable") + 1.0
    return x


def register(spark: SparkSession) -> None:
    """Table functions ``change_points`` and ``detect_changes``, and scalar ones of (p, n): penalty_mbic, penalty_bic,
    penalty_mdl.

    ``SELECT * FROM change_points(TABLE(t) PARTITION BY k ORDER BY (ts), 'mean')`` reads the columns ``k`` and ``v`` of its
    input and gives (k, cp).

    ``SELECT * FROM detect_changes(TABLE(t), series => 'shop, item', sort => 'day', value => 'sold, price', family =>
    'variance', beta => 'BIC', trim => 0.02, pruning => 'exact')`` takes any key, sort and value columns, ``x`` for
    predictors, and the options of ``Spec`` by name (``order`` as '1, 1'). It deals and sorts the rows itself, reads only the
    columns named, and gives the keys, with their own types, and cp as ``Detection.raw_change_points`` has it.
    """
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

    from ..operators.detect import Spec

    class ChangePoints:
        def __init__(self):
            self.rows, self.key, self.family = [], None, "mean"

        def eval(self, row, family: str):
            self.key, self.family = str(row["k"]), family
            self.rows.append(float(row["v"]))

        def terminate(self):
            for cp in Spec(family=self.family).solve(np.array(self.rows)[:, None]) if self.rows else ():
                yield self.key, int(cp)

    class DetectChanges:
        @staticmethod
        def analyze(rows: AnalyzeArgument, series: AnalyzeArgument, sort: AnalyzeArgument, value: AnalyzeArgument, x: AnalyzeArgument | None = None, **options: AnalyzeArgument) -> AnalyzeResult:
            keys, order, columns = _split(series.value), _split(sort.value), [*_split(value.value), *_split(x.value if x else None)]
            known = {f.name: f for f in rows.dataType.fields}
            missing = [c for c in [*keys, *order, *columns] if c not in known]
            if missing or not keys or not order or not columns:
                raise ValueError(f"no column {', '.join(missing)}" if missing else "series, sort and value name columns")
            Spec(**_options({k: v.value for k, v in options.items()}))
            schema = T.StructType([*[T.StructField(k, known[k].dataType) for k in keys], T.StructField("cp", T.LongType())])
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn(c) for c in order], select=[SelectedColumn(c) for c in dict.fromkeys([*keys, *order, *columns])])

        def __init__(self):
            self.rows, self.key, self.spec, self.responses = [], None, None, 0

        def eval(self, rows, series, sort, value, x=None, **options):
            if self.spec is None:
                self.spec = Spec(**_options(options))
                self.key, self.responses = tuple(rows[k] for k in _split(series)), len(_split(value))
                self.columns = [*_split(value), *_split(x)]
            self.rows.append([np.nan if rows[c] is None else float(rows[c]) for c in self.columns])

        def terminate(self):
            if self.spec is not None and len(self.rows) > self.spec.lag:
                for cp in self.spec.solve(_columns(np.array(self.rows), self.spec, self.responses)):
                    yield (*self.key, int(cp) + self.spec.lag)

    spark.udtf.register("change_points", udtf(ChangePoints, returnType="k: string, cp: bigint"))
    spark.udtf.register("detect_changes", udtf(DetectChanges))
    penalty.register(spark)
