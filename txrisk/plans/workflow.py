"""A detection workflow assembled from options: features, clean-up, encoding, reduction, scores, classifier."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk.functions import rows as R
from txrisk.functions.scale import checkpoint, keep
from txrisk.operators import encoders as E, models as M, outliers as O, resample as X, selection as Sel
from txrisk.plans.features import FeatureOptions, FeatureState, build_features, fit_features
from txrisk.schema import DEFAULT, Columns


@dataclass
class WorkflowOptions:
    features: FeatureOptions = field(default_factory=FeatureOptions)
    engineer: bool = True                 # False: the input already is a feature table
    encoder: str = "count"                # count, target, woe, ordered, onehot, hashing
    id_columns: tuple[str, ...] = ("AccountId", "CUSTOMER_ID", "CustomerUID", "SubscriptionId", "BatchId")
    drop: tuple[str, ...] = ("CurrencyCode", "CountryCode")
    scaler: str = "robust"                # robust, standard, minmax, none
    interaction_columns: tuple[str, ...] = ()
    pca: int = 0
    select_k: int = 0
    selector: str = "f"                   # mi, f, corr, correlated
    detectors: tuple[str, ...] = ()
    detector_params: dict = field(default_factory=dict)
    nystroem: int = 0
    sampler: str | None = None
    sampler_params: dict = field(default_factory=dict)
    classifier: str = "gbt"
    classifier_params: dict = field(default_factory=dict)
    class_weight: str | float = "balanced"
    threshold: float = 0.5
    seed: int = 0


class Workflow:
    """``fit`` learns every stage on training rows only and returns a ``FittedWorkflow``."""

    def __init__(self, options: WorkflowOptions | None = None, cols: Columns = DEFAULT):
        self.o, self.cols = options or WorkflowOptions(), cols

    def fit(self, train: DataFrame) -> "FittedWorkflow":
        o, cols = self.o, self.cols
        f = FittedWorkflow(o, cols, train.sparkSession)
        if o.engineer:
            f.state = fit_features(train, o.features, cols)
        x = checkpoint(f.feature_table(train))   # read by every later stage
        numeric, ids, cats = f.route(x)
        f.constant = R.constant_columns(x, names=[*numeric, *cats])
        rest = x.select(*[c for c in [*numeric, *cats] if c not in f.constant])
        f.duplicate = R.duplicate_columns(rest)
        numeric = [c for c in numeric if c not in f.constant and c not in f.duplicate]
        cats = [c for c in cats if c not in f.constant and c not in f.duplicate]
        f.numeric, f.ids, f.cats = numeric, ids, cats
        f.fit_encoders(x)
        x = checkpoint(f.encode(x, train=True))
        if o.scaler != "none" and numeric:
            fit = {"robust": E.robust_scaler, "standard": E.standard_scaler, "minmax": E.minmax_scaler}[o.scaler]
            f.scaling = {c: list(v) for c, v in fit(x, numeric).params.items()}
            x = E.LinearScaler({c: tuple(v) for c, v in f.scaling.items()}).transform(x)
        names = [*numeric, *f.encoded_names(x)]
        if o.interaction_columns:
            x = E.interactions(x, list(o.interaction_columns))
            names += ["*".join(g) for g in combinations(o.interaction_columns, 2)]
        x = x.na.fill(0.0, names)
        if o.pca:
            p = Sel.pca(x, names, o.pca)
            mean, sd = zip(*[p.scaler.params[c] for c in names])
            f.projection = {"names": names, "mean": list(mean), "sd": list(sd), "pc": p.model.pc.toArray().tolist()}
            x = f.project(x)
            names = [f"pca_{i}" for i in range(p.k)]
        if o.select_k:
            names = (Sel.smart_correlated_selection(x, names) if o.selector == "correlated"
                     else Sel.select_k_best(x, names, cols.label, o.select_k, o.selector))
        f.inputs = list(names)
        if o.nystroem:
            f.kernel = Sel.nystroem(x, names, o.nystroem, cols=cols)
            x = f.kernel.transform(x)
            names = [f"nystroem_{i}" for i in range(len(f.kernel.landmarks))]
        for d in o.detectors:
            model = O.fit_detector(x, f.inputs, d, cols, **o.detector_params.get(d, {}))
            f.detectors[d] = model
            x = model.transform(x, d)
        f.final = [*names, *o.detectors]
        if o.sampler:
            x = X.SAMPLERS[o.sampler](x.select(cols.id, cols.label, *f.final), f.final, cols=cols, **o.sampler_params)
        x = M.class_weights(x.select(cols.label, *[F.col(c).cast("double").alias(c) for c in f.final]), o.class_weight, cols)
        assembler = VectorAssembler(inputCols=f.final, outputCol="features")
        learner = (M.perceptron(len(f.final), cols=cols, **o.classifier_params) if o.classifier == "mlp"
                   else M.LEARNERS[o.classifier](cols, **o.classifier_params))
        fitted = learner.fit(keep(assembler.transform(x)))
        f.model = PipelineModel(stages=[assembler, fitted])
        return f


class FittedWorkflow:
    def __init__(self, o: WorkflowOptions, cols: Columns, spark: SparkSession):
        self.o, self.cols, self.spark = o, cols, spark
        self.state: FeatureState | None = None
        self.constant: list[str] = []
        self.duplicate: list[str] = []
        self.numeric: list[str] = []
        self.ids: list[str] = []
        self.cats: list[str] = []
        self.prior: float = 0.0
        self.table: DataFrame | None = None
        self.values: dict[str, list[str]] = {}
        self.scaling: dict[str, list[float]] = {}
        self.projection: dict = {}
        self.inputs: list[str] = []
        self.kernel = None
        self.detectors: dict = {}
        self.final: list[str] = []
        self.model: PipelineModel | None = None

    def feature_table(self, df: DataFrame) -> DataFrame:
        x = build_features(df, self.state, self.o.features, self.cols) if self.o.engineer else df
        return x.drop(*self.o.drop)

    def route(self, x: DataFrame) -> tuple[list[str], list[str], list[str]]:
        r = R.route_columns(x, ids=list(self.o.id_columns), skip=[self.cols.id, self.cols.label, self.cols.ts, self.cols.day])
        return r["numeric"], r["ids"], r["categorical"]

    def fit_encoders(self, x: DataFrame) -> None:
        """One (column, category) table for ids and categoricals."""
        names = [*self.ids, *self.cats]
        if not names:
            return
        self.prior = E.overall_rate(x, self.cols)
        t = E.category_table(x, names, self.cols.label)
        n = x.agg(F.count("*").alias("n"), F.sum(F.col(self.cols.label).cast("double")).alias("p")).first()
        count, pos = F.col("n"), F.col("pos")
        s = 1 / (1 + F.exp(-(count - 20.0) / 10.0))
        value = {
            "target": F.when(count == 1, F.lit(self.prior)).otherwise(self.prior * (1 - s) + pos / count * s),
            "woe": F.log(((pos + 1) / (n["p"] + 2)) / ((count - pos + 1) / (n["n"] - n["p"] + 2))),
            "ordered": (pos + self.prior) / (count + 1),
        }.get(self.o.encoder, count.cast("double"))
        chosen = F.when(F.col("column").isin(self.ids), count.cast("double")).otherwise(value)
        self.table = keep(t.select("column", "category", chosen.alias("v")))
        if self.o.encoder == "onehot":
            self.values = {c: E.category_values(x, c) for c in self.cats}

    def encode(self, x: DataFrame, train: bool = False) -> DataFrame:
        if self.ids:
            x = E.TableEncoder(self.table, self.ids, ["v"], {"v": 0.0}, suffix="_enc").transform(x)
        if not self.cats:
            return x
        if self.o.encoder == "onehot":
            return E.one_hot(x, self.cats, self.values)
        if self.o.encoder == "hashing":
            return E.hashing_encoder(x, self.cats)
        if self.o.encoder == "ordered" and train:
            got = E.OrderedTargetEncoder(self.table, self.cats, self.prior, self.cols, "_enc")
            return got.transform_train(x)
        unseen = {"target": self.prior, "ordered": self.prior}.get(self.o.encoder, 0.0)
        return E.TableEncoder(self.table, self.cats, ["v"], {"v": unseen}, suffix="_enc").transform(x)

    def encoded_names(self, x: DataFrame) -> list[str]:
        ids = [f"{c}_enc" for c in self.ids]
        if self.o.encoder == "onehot":
            return ids + [f"{c}_{v}" for c in self.cats for v in self.values[c]]
        if self.o.encoder == "hashing":
            return ids + ([f"hash_{j}" for j in range(8)] if self.cats else [])
        return ids + [f"{c}_enc" for c in self.cats]

    def project(self, x: DataFrame) -> DataFrame:
        p = self.projection
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(p["names"], p["mean"], p["sd"])]
        vec = F.array(*z)
        dot = lambda i: F.aggregate(F.zip_with("__z", F.array(*[F.lit(float(r[i])) for r in p["pc"]]), lambda a, b: a * b),
                                    F.lit(0.0), lambda s, v: s + v)
        k = len(p["pc"][0])
        return x.withColumn("__z", vec).select("*", *[dot(i).alias(f"pca_{i}") for i in range(k)]).drop("__z")

    def prepare(self, df: DataFrame) -> DataFrame:
        x = self.encode(self.feature_table(df))
        x = E.LinearScaler({c: tuple(v) for c, v in self.scaling.items()}).transform(x) if self.scaling else x
        if self.o.interaction_columns:
            x = E.interactions(x, list(self.o.interaction_columns))
        floats = [f.name for f in x.schema if isinstance(f.dataType, T.NumericType)]
        x = x.na.fill(0.0, floats)
        if self.projection:
            x = self.project(x)
        if self.kernel is not None:
            x = self.kernel.transform(x)
        for name, d in self.detectors.items():
            x = d.transform(x, name)
        return x

    def transform(self, df: DataFrame) -> DataFrame:
        """Input id, label if present, fraud probability and predicted class."""
        x = self.prepare(df)
        kept = [c for c in (self.cols.id, self.cols.label, self.cols.day, self.cols.customer) if c in x.columns]
        x = x.select(*kept, *[F.col(c).cast("double").alias(c) for c in self.final if c not in kept])
        return M.score_table(self.model, x, self.o.threshold).select(*kept, "predictions", "predicted")

    # ---------------------------------------------------------------- persistence

    def save(self, path: str) -> None:
        o = asdict(self.o)
        spec = {
            "options": o, "state": self.state.to_json() if self.state else None, "constant": self.constant,
            "duplicate": self.duplicate, "numeric": self.numeric, "ids": self.ids, "cats": self.cats, "prior": self.prior,
            "values": self.values, "scaling": self.scaling, "projection": self.projection, "inputs": self.inputs,
            "final": self.final, "cols": asdict(self.cols),
            "detectors": {k: O.detector_state(v) for k, v in self.detectors.items()},
            "kernel": None if self.kernel is None else {
                "landmarks": self.kernel.landmarks.tolist(), "basis": self.kernel.basis.tolist(),
                "features": self.kernel.features, "gamma": self.kernel.gamma, "degree": self.kernel.degree},
        }
        self.spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
        if self.state is not None and self.state.rates is not None:
            self.state.rates.write.mode("overwrite").parquet(f"{path}/rates")
        if self.table is not None:
            self.table.write.mode("overwrite").parquet(f"{path}/encoder")
        self.model.write().overwrite().save(f"{path}/model")

    def write(self):
        """The ``model.write().overwrite().save(path)`` form used by ``BestRun``."""
        outer = self

        class _Writer:
            def overwrite(self):
                return self

            def save(self, path):
                outer.save(path)

        return _Writer()

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedWorkflow":
        import numpy as np
        spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
        o = spec["options"]
        tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        options = WorkflowOptions(**{**tuples(o), "features": FeatureOptions(**tuples(o["features"]))})
        f = FittedWorkflow(options, Columns(**tuples(spec["cols"])), spark)
        if spec["state"]:
            f.state = FeatureState.from_json(spec["state"], spark.read.parquet(f"{path}/rates") if options.features.rate_columns else None)
        for k in ("constant", "duplicate", "numeric", "ids", "cats", "prior", "values", "scaling", "projection", "inputs", "final"):
            setattr(f, k, spec[k])
        f.detectors = {k: O.detector_from_state(v) for k, v in spec["detectors"].items()}
        if spec["kernel"]:
            k = spec["kernel"]
            f.kernel = Sel.NystroemMap(np.array(k["landmarks"]), np.array(k["basis"]), k["features"], k["gamma"], k["degree"])
        if f.ids or f.cats:
            f.table = spark.read.parquet(f"{path}/encoder")
        f.model = PipelineModel.load(f"{path}/model")
        return f
