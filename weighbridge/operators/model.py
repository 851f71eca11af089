"""A rule-scored model: weighted variables plus weighted pair rules, per output label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

CATEGORICAL = "categorical"
NUMERICAL = "numerical"


@dataclass(frozen=True)
class Variable:
    name: str
    categories: int
    kind: str = CATEGORICAL
    weights: dict[int, dict[int, float]] = field(default_factory=dict)
    scores: dict[int, dict[int, float]] = field(default_factory=dict)
    spans: list[tuple[float, float]] = field(default_factory=list)
    low: dict[int, float] = field(default_factory=dict)
    high: dict[int, float] = field(default_factory=dict)
    rising: dict[int, bool] = field(default_factory=dict)
    score: dict[int, float] = field(default_factory=dict)

    @property
    def numerical(self) -> bool:
        return self.kind == NUMERICAL


@dataclass(frozen=True)
class Rule:
    name: str
    var_a: str
    val_a: int
    var_b: str
    val_b: int
    weight: float
    score: float


@dataclass(frozen=True)
class Model:
    labels: int
    variables: list[Variable]
    rules: list[Rule] = field(default_factory=list)

    @property
    def sizes(self) -> list[int]:
        return [v.categories for v in self.variables]

    def variable(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)

    # -- parameter tables ---------------------------------------------------------------
    def category_rows(self):
        return [
            (v.name, lbl, cat, float(v.weights[lbl][cat]), float(v.scores[lbl][cat]))
            for v in self.variables if not v.numerical
            for lbl in range(self.labels) for cat in range(v.categories)
        ]

    def numeric_rows(self):
        return [
            (v.name, lbl, float(v.low[lbl]), float(v.high[lbl]), bool(v.rising[lbl]), float(v.score[lbl]))
            for v in self.variables if v.numerical for lbl in range(self.labels)
        ]

    def span_rows(self):
        return [
            (v.name, i, float(lo), float(hi), i == len(v.spans) - 1)
            for v in self.variables if v.numerical for i, (lo, hi) in enumerate(v.spans)
        ]

    def rule_rows(self):
        return [
            (i, r.name, r.var_a, r.val_a, r.var_b, r.val_b, float(r.weight), float(r.score))
            for i, r in enumerate(self.rules)
        ]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The model as long tables; their size is fixed by the model, not by the data."""
        make = lambda rows, schema: small_table(spark, rows, schema)
        return {
            "categories": make(self.category_rows(), "var string, label int, cat int, weight double, score double"),
            "numeric": make(self.numeric_rows(),
                            "var string, label int, low double, high double, rising boolean, score double"),
            "spans": make(self.span_rows(), "var string, idx int, lo double, hi double, is_last boolean"),
            "rules": make(self.rule_rows(),
                          "ord int, name string, var_a string, val_a int, var_b string, val_b int, "
                          "weight double, score double"),
        }


def small_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows as literals of the plan, so Spark knows how small the table is and joins by broadcast."""
    def text(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{x!r}D" if isinstance(x, float) else str(x)

    fields = [f.strip().split(" ") for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in rows)
    names = ", ".join(n for n, _ in fields)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in fields)} FROM VALUES {values} AS t({names})")


def model_from_tables(categories, numeric, spans, rules, labels: int, order: list[str]) -> Model:
    """Build a driver-side model from the (small) parameter rows of one model id."""
    by_var: dict[str, dict] = {}
    for r in categories:
        d = by_var.setdefault(r["var"], {"w": {}, "s": {}})
        d["w"].setdefault(r["label"], {})[r["cat"]] = r["weight"]
        d["s"].setdefault(r["label"], {})[r["cat"]] = r["score"]
    variables = []
    for name in order:
        num = [r for r in numeric if r["var"] == name]
        if num:
            cuts = [(r["lo"], r["hi"]) for r in sorted((s for s in spans if s["var"] == name), key=lambda s: s["idx"])]
            variables.append(Variable(
                name, len(cuts), NUMERICAL, spans=cuts,
                low={r["label"]: min(r["low"], r["high"]) for r in num},
                high={r["label"]: max(r["low"], r["high"]) for r in num},
                rising={r["label"]: r["rising"] for r in num}, score={r["label"]: r["score"] for r in num}))
        else:
            d = by_var[name]
            variables.append(Variable(name, len(d["w"][0]), weights=d["w"], scores=d["s"]))
    return Model(labels, variables, [
        Rule(r["name"], r["var_a"], r["val_a"], r["var_b"], r["val_b"], r["weight"], r["score"])
        for r in sorted(rules, key=lambda r: r["ord"])
    ])
