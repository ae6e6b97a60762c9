"""Model files: mixture text in macro form, mixture XML, model tables in Parquet."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from ..models.gaussian import Mixture

TABLE = "model string, comp int, weight double, mean array<double>, var array<double>"


def parse_macros(text: str) -> dict[str, dict]:
    """Models of macro text: name -> {states: {number: Mixture}, trans: rows or None}. Diagonal variances."""
    tokens = re.findall(r'"[^"]*"|<[^>]*>|~\w|[^\s<>]+', text)
    out: dict = {}
    k, model, state, comp = 0, None, 0, None

    def numbers(k, n):
        return [float(x) for x in tokens[k : k + n]], k + n

    def commit():
        nonlocal comp
        if model is not None and comp and "mean" in comp:
            m = out[model]["states"].setdefault(state, Mixture([], [], []))
            m.weights.append(comp.get("w", 1.0))
            m.means.append(comp["mean"])
            m.covs.append(comp.get("var", [1.0] * len(comp["mean"])))
        comp = {}

    while k < len(tokens):
        t = tokens[k].upper()
        k += 1
        if t == "~H":
            commit()
            model, state = tokens[k].strip('"'), 0
            out[model] = {"states": {}, "trans": None}
            k += 1
        elif t == "<STATE>":
            commit()
            state, k = int(tokens[k]), k + 1
        elif t == "<MIXTURE>":
            commit()
            comp, k = {"w": float(tokens[k + 1])}, k + 2
        elif t == "<MEAN>":
            if comp and "mean" in comp:
                commit()
            comp = comp or {}
            comp["mean"], k = numbers(k + 1, int(tokens[k]))
        elif t == "<VARIANCE>":
            if model is None:
                k += 1 + int(tokens[k])
            else:
                comp = comp or {}
                comp["var"], k = numbers(k + 1, int(tokens[k]))
        elif t == "<TRANSP>":
            commit()
            n = int(tokens[k])
            flat, k = numbers(k + 1, n * n)
            out[model]["trans"] = [flat[i * n : (i + 1) * n] for i in range(n)]
        elif t == "<ENDHMM>":
            commit()
            model = None
    commit()
    return out


def macro_text(models: dict[str, Mixture], stay: float = 0.9, kind: str = "USER") -> str:
    """One-state models in macro form, self-loop ``stay``."""
    size = len(next(iter(models.values())).means[0])
    row = lambda v: " ".join(f"{x:.9e}" for x in v)
    out = [f"~o <VecSize> {size} <{kind}>"]
    for name, m in models.items():
        out += [f'~h "{name}"', "<BeginHMM>", "<NumStates> 3", "<State> 2", f"<NumMixes> {m.size}"]
        for i, (w, mean, var) in enumerate(zip(m.weights, m.means, m.covs), 1):
            out += [f"<Mixture> {i} {w:.9e}", f"<Mean> {size}", row(mean), f"<Variance> {size}", row(var)]
        out += ["<TransP> 3", "0 1 0", f"0 {stay} {1 - stay:.9g}", "0 0 0", "<EndHMM>"]
    return "\n".join(out) + "\n"


def parse_xml(text: str) -> list[Mixture]:
    """Mixtures of XML text; weights are normalised."""
    out, root = [], ET.fromstring(text)
    for g in [root] if root.tag == "gmm" else root.iter("gmm"):
        parts = [(float(m.findtext("weight")), [float(v) for v in re.split(r"[\s,;]+", m.findtext("mean").strip())], m.find("covariance")) for m in g.iter("mixture")]
        total, kinds = sum(p[0] for p in parts), {p[2].get("type", "diag") for p in parts}
        kind = kinds.pop() if len(kinds) == 1 else "full"
        covs = []
        for _, mean, c in parts:
            v = [float(x) for x in re.split(r"[\s,;]+", c.text.strip())]
            d = len(mean)
            covs.append([v[i * d : (i + 1) * d] for i in range(d)] if kind == "full" else v[0] if kind == "spherical" else v)
        out.append(Mixture([p[0] / total for p in parts], [p[1] for p in parts], covs, kind))
    return out


def write_models(spark: SparkSession, models: dict[str, Mixture], path: str) -> None:
    """Diagonal mixtures as a Parquet table."""
    rows = [(name, k, float(w), [float(x) for x in m], [float(x) for x in c]) for name, g in models.items() for k, (w, m, c) in enumerate(zip(g.weights, g.means, g.covs))]
    spark.createDataFrame(rows, TABLE).write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str) -> dict[str, Mixture]:
    """Mixtures of a table as written by write_models; the table is model-sized."""
    table: DataFrame = spark.read.schema(TABLE).parquet(path)
    out: dict[str, Mixture] = {}
    for r in table.orderBy("model", "comp").collect():
        g = out.setdefault(r["model"], Mixture([], [], []))
        g.weights.append(r["weight"])
        g.means.append(list(r["mean"]))
        g.covs.append(list(r["var"]))
    return out
