"""Development effort, schedule and cost under four models, as column expressions over code lines and complexity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the models and prices.
COCOMO_BASIC = {"organic": (2.4, 1.05, 2.5, 0.38), "semi-detached": (3.0, 1.12, 2.5, 0.35), "embedded": (3.6, 1.20, 2.5, 0.32)}
COCOMO_2_SCALE = (3.72, 3.04, 4.24, 3.29, 4.68)
#: Presets of the token model: price of a million input and output tokens, tokens a second.
LOCOMO_PRESETS = {"large": (10.0, 30.0, 30.0), "medium": (3.0, 15.0, 50.0), "small": (0.5, 2.0, 100.0), "local": (0.0, 0.0, 15.0)}


@dataclass
class Salary:
    average_wage: float = 56_286.0
    overhead: float = 2.4

    def cost(self, effort: Column) -> Column:
        return effort * (self.average_wage / 12.0) * self.overhead


@dataclass
class EstimationModel:
    """A model: effort in person-months and schedule in months from (code, cyclomatic), and optionally cost."""

    name: str
    effort: Callable[[Column, Column], Column]
    schedule: Callable[[Column, Column, Column], Column]
    cost: Callable[[Column, Column], Column] | None = None
    params: dict = field(default_factory=dict)


def _power(x: Column, y: float) -> Column:
    return F.pow(x.cast("double"), F.lit(float(y)))


def cocomo_basic(project: str = "organic", eaf: float = 1.0) -> EstimationModel:
    a, b, c, d = COCOMO_BASIC[project]
    return EstimationModel("COCOMO Basic", lambda code, _: a * _power(code / 1000.0, b) * eaf, lambda e, code, _: c * _power(e, d), params={"Project Type": project, "EAF": eaf})


def cocomo_2(eaf: float = 1.0, scale=COCOMO_2_SCALE, a: float = 2.94, b: float = 0.91, c: float = 3.67, d: float = 0.28) -> EstimationModel:
    """scale: the scale factors; their sum alone counts."""
    e = b + 0.01 * sum(scale)
    f = d + 0.2 * (e - b)
    return EstimationModel("COCOMO II", lambda code, _: a * eaf * _power(code / 1000.0, e), lambda eff, code, _: c * _power(eff, f), params={"A": a, "E (exponent)": round(e, 4), "SF sum": sum(scale), "EAF": eaf})


def putnam(ck: float = 8000.0, d0: float = 15.0) -> EstimationModel:
    years = lambda code: _power(code / (ck * d0 ** (1 / 3)), 3 / 7)
    some = lambda code, x: F.when(code > 0, x).otherwise(0.0)
    return EstimationModel("Putnam (SLIM)", lambda code, _: some(code, d0 * _power(years(code), 3) * 12.0), lambda e, code, _: some(code, years(code) * 12.0), params={"Ck": ck, "D0": d0})


def locomo(preset: str = "medium", tokens_per_line: float = 10.0, input_per_line: float = 20.0, complexity_weight: float = 5.0, iterations: float = 1.5, iteration_weight: float = 2.0, minutes_per_line: float = 0.1, input_price: float | None = None, output_price: float | None = None, tokens_per_second: float | None = None) -> EstimationModel:
    """Prices and speed come from the preset unless they are given."""
    in_price, out_price, speed = (own if own is not None else usual for own, usual in zip((input_price, output_price, tokens_per_second), LOCOMO_PRESETS[preset], strict=True))

    def tokens(code: Column, cyclomatic: Column) -> tuple[Column, Column]:
        root = F.sqrt(F.when(code > 0, cyclomatic / code).otherwise(0.0))
        rounds = iterations + root * iteration_weight
        return code * input_per_line * (1.0 + root * complexity_weight) * rounds, code * tokens_per_line * rounds

    return EstimationModel(
        "LOCOMO", lambda code, _: code * minutes_per_line / 60.0 / 160.0, lambda e, code, cc: tokens(code, cc)[1] / speed / (730.0 * 3600.0),
        lambda code, cc: tokens(code, cc)[0] / 1e6 * in_price + tokens(code, cc)[1] / 1e6 * out_price, {"preset": preset, "input price": in_price, "output price": out_price, "tokens per second": speed},
    )


def all_models() -> list[EstimationModel]:
    return [cocomo_basic(), cocomo_2(), putnam(), locomo()]


def estimate(totals: DataFrame, model: EstimationModel, salary: Salary | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, model, code_lines, effort_months, schedule_months, people and cost of rows with code and cyclomatic."""
    code, cc, salary = F.col("code"), F.col("cyclomatic"), salary or Salary()
    out = totals.select(*keys, F.lit(model.name).alias("model"), code.alias("code_lines"), cc.alias("_cc"), model.effort(code, cc).alias("effort_months"))
    code, cc, effort = F.col("code_lines"), F.col("_cc"), F.col("effort_months")
    out = out.withColumn("schedule_months", model.schedule(effort, code, cc))
    people = F.when(F.col("schedule_months") > 0, effort / F.col("schedule_months")).otherwise(0.0)
    return out.select(*keys, "model", "code_lines", "effort_months", "schedule_months", people.alias("people"), (model.cost(code, cc) if model.cost else salary.cost(effort)).alias("cost"))


def estimate_all(totals: DataFrame, models: list[EstimationModel] | None = None, salary: Salary | None = None) -> DataFrame:
    """A row a model."""
    rows = [estimate(totals, m, salary) for m in models or all_models()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def estimate_by_language(by_language: DataFrame, model: EstimationModel | None = None, salary: Salary | None = None) -> DataFrame:
    """Languages with code, the dearest first. Models are not linear: the parts do not add up to the whole."""
    return estimate(by_language.where("code > 0"), model or cocomo_basic(), salary, ("language",)).orderBy(F.desc("cost"), "language")
