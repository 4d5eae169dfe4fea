"""Copy numbers from a mixture, principal bundles of haplotypes, and phenome-wide associations."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from .rounds import settled

PARAMETERS = "intercept double, slope double, offset double, sigma double, states array<double>, weights array<double>"


def mixture_parameters(labelled: DataFrame, group: str, x: str, y: str, pool: DataFrame | None = None) -> DataFrame:
    """A row of parameters (PARAMETERS) for each group, to be kept as a Parquet table. labelled (group, x, y), pool (group, x);
    a group is one assay's samples and is fitted in one task."""
    kind = labelled.schema[group].dataType.simpleString()
    rows = labelled.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(True).alias("known"))
    if pool is not None:
        rows = rows.unionByName(pool.select(group, F.col(x).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("known")))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        known = p["known"].to_numpy(bool)
        m = N.labelled_mixture(p["x"][known].to_numpy(), p["y"][known].to_numpy(), p["x"][~known].to_numpy())
        return pd.DataFrame({group: [p[group].iloc[0]], **{k: [m[k]] for k in ("intercept", "slope", "offset", "sigma")}, "states": [m["states"]], "weights": [m["weight"]]})

    return rows.groupBy(group).applyInPandas(fit, f"`{group}` {kind}, {PARAMETERS}")


def mixture_states(df: DataFrame, parameters: DataFrame, group: str, x: str) -> DataFrame:
    """df plus state, the likeliest state of x; the smaller one of equals."""
    joined = df.join(F.broadcast(parameters.withColumnRenamed(group, "__g")), F.col(group) == F.col("__g"))
    scaled = F.col("intercept") + F.col("slope") * F.col(x)
    log = lambda s, w: F.log(F.greatest(w, F.lit(1e-300))) - 0.5 * F.pow((scaled - s - F.col("offset")) / F.col("sigma"), F.lit(2))
    scores = F.zip_with("states", "weights", lambda s, w: F.struct(log(s, w).alias("score"), (-s).alias("s")))
    return joined.select(*df.columns, (-F.array_max(scores)["s"]).cast("long").alias("state"))


# Fixed values of the curated bundles: raw ids that vote for each kind of gene, upstream patterns whose boundary reaches to the last
# 1 among the first four pieces, the one that has an intergenic piece after its first, what follows a gene, and the numbers in labels.
LONG_VOTES = ("3", "7", "10", "11", "4")
SHORT_VOTES = ("3", "6", "9", "13", "5")
UPSTREAM = (("1", "3"), ("1", "8", "3"), ("1", "2", "1", "3"))
UPSTREAM_WITH_PIECE = ("1", "2", "8", "3")
AFTER_GENE = ("12", "2", "0")
WIDTHS = {"0": "52:0:0:51", "1": "61:0:0:60", "2": "34:0:1:33", "3": "94:0:0:93", "4": "19:0:0:18", "5": "94:0:0:93", "6": "94:0:0:93", "7": "19:0:0:18"}


class UnknownPattern(ValueError):
    pass


def _gene_kind(ids: list[str]) -> str:
    """long, short, or a fusion of both, by the raw bundles of a gene."""
    n = Counter(ids)
    long_votes, short_votes = sum(n[b] for b in LONG_VOTES), sum(n[b] for b in SHORT_VOTES)
    if long_votes > short_votes and (not n["5"] or n["4"] == 2):
        return "long"
    if short_votes > long_votes and (not n["4"] or n["5"] == 2):
        return "short"
    if n["7"] and n["5"] and not n["9"] and not n["13"]:
        return "long-short"
    if n["6"] and n["4"] and not n["10"] and not n["11"]:
        return "short-long"
    raise UnknownPattern(f"gene of {ids}")


def _gene_pieces(kind: str, ids: list[str]) -> list[tuple[str, int, int]]:
    """Curated bundles of a gene after its first raw piece: (bundle, first, last + 1)."""
    head, mark, tail = {"long": ("3", "4", "4"), "short": ("6", "5", "7"), "long-short": ("3", "4", "7"), "short-long": ("6", "5", "4")}[kind]
    cut = ids.index(mark)
    if kind in ("long", "short"):
        return [(head, 0, cut), (tail, cut, len(ids))]
    return [(head, 0, cut), ({"4": "4", "5": "7"}[mark], cut, cut + 1), (tail, cut + 1, len(ids))]


def curated_bundles(raw: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int, str]]:
    """Curated (bundle, type, start, end, label) of the raw (bundle, start, end) of one haplotype in order. A bundle is R if
    genes repeat it, U otherwise. What no rule knows raises UnknownPattern."""
    ids = [r[0] for r in raw]
    first = min(r[1] for r in raw)
    if any(tuple(ids[: len(pattern)]) == pattern for pattern in UPSTREAM):
        begin = max(i for i, b in enumerate(ids[:4]) if b == "1") + 1
        out = [("0", "U", first, raw[begin - 1][2], None)]
    elif tuple(ids[:4]) == UPSTREAM_WITH_PIECE:
        begin = 3
        out = [("0", "U", first, raw[0][2], "0:52:0:0:5:U"), ("5", "U", raw[1][1], raw[2][2], "5:52:0:0:51:U")]
    else:
        raise UnknownPattern(f"upstream of {ids[:4]}")
    starts = [i for i in range(begin, len(ids)) if ids[i] == "3"]
    ends = [i for i in range(begin, len(ids) - 1) if ids[i] in ("4", "5") and ids[i + 1] in AFTER_GENE]
    if len(starts) != len(ends):
        raise UnknownPattern(f"{len(starts)} gene starts and {len(ends)} ends")
    spans = list(zip(starts, ends, strict=True))
    kinds = [_gene_kind(ids[a : b + 1]) for a, b in spans]
    count = Counter(kinds)
    # Genes that hold each bundle. The last piece of a short-long gene is typed like its middle one.
    four = count["long"] + count["long-short"] + count["short-long"]
    holders = {"2": len(spans), "3": count["long"] + count["long-short"], "4": four, "6": count["short"] + count["short-long"], "7": count["short"] + count["long-short"]}
    kind_of = lambda bundle, gene: "R" if (four if gene == "short-long" and bundle == "7" else holders[bundle]) > 1 else "U"
    for k, ((a, b), gene) in enumerate(zip(spans, kinds, strict=True)):
        out.append(("2", kind_of("2", gene), raw[a][1], raw[a][2], None))
        inner = raw[a + 1 : b + 1]
        for bundle, lo, hi in _gene_pieces(gene, [r[0] for r in inner]):
            own = inner[lo:hi]
            out.append((bundle, kind_of(bundle, gene), min(r[1] for r in own), max(r[2] for r in own), None))
        if k + 1 < len(spans):
            own = raw[b + 1 : starts[k + 1]]
            out.append(("5", "R" if len(spans) > 2 else "U", min(r[1] for r in own), max(r[2] for r in own), None))
    last = raw[-2:] if len(raw) > 1 and ids[-2] == "12" else raw[-1:]
    out.append(("1", "U", min(r[1] for r in last), max(r[2] for r in last), None))
    return [(bundle, kind, start, end, label or f"{bundle}:{WIDTHS[bundle]}:{kind}") for bundle, kind, start, end, label in out]


def principal_bundles(raw: DataFrame, haplotype: str, order: str) -> DataFrame:
    """raw (haplotype, order, bundle, s, e) -> haplotype, place, bundle, kind, s, e, label, path; a haplotype is one assembly's
    few dozen pieces."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        rows = curated_bundles(list(zip(p["bundle"], p["s"].tolist(), p["e"].tolist(), strict=True)))
        out = pd.DataFrame(rows, columns=["bundle", "kind", "s", "e", "label"])
        out.insert(0, "place", np.arange(len(out)))
        out.insert(0, haplotype, p[haplotype].iloc[0])
        return out.assign(path="+".join(out["bundle"]))

    kind = raw.schema[haplotype].dataType.simpleString()
    slim = raw.select(haplotype, order, F.col("bundle").cast("string").alias("bundle"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    return slim.groupBy(haplotype).applyInPandas(run, f"`{haplotype}` {kind}, place long, bundle string, kind string, s long, e long, label string, path string")


def phenome_marks(records: DataFrame, people: DataFrame, code_map: DataFrame, exclusions: DataFrame, person: str) -> DataFrame:
    """(person, phenotype, case): 1 for who has a code of the phenotype, 0 for who has none but one of its excluded range and so is no
    control either. Everybody else is a control and has no row: phenotypes times people is never built.

    records (person, code), people (person), code_map (code, phenotype), exclusions (phenotype, excluded phenotype). Many may have one code, so
    people's own codes are told apart before they meet the lists.
    """
    known = records.select(person, "code").distinct().join(people.select(person), person, "left_semi")
    own = known.join(code_map, "code").select(person, "phenotype").distinct()
    barred = own.join(exclusions.select(F.col("excluded").alias("phenotype"), F.col("phenotype").alias("of")), "phenotype").select(person, F.col("of").alias("phenotype"), F.lit(0).alias("case"))
    return own.withColumn("case", F.lit(1)).unionByName(barred).groupBy(person, "phenotype").agg(F.max("case").alias("case"))


def phenome_counts(marks: DataFrame, people: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """(phenotype, cases, controls) of all phenotypes: the controls are the people without a mark."""
    total = people.agg(F.count("*").alias("__n"))  # one number
    counted = marks.groupBy("phenotype").agg(F.sum("case").alias("cases"), F.count("*").alias("__marked"))
    joined = phenotypes.select("phenotype").distinct().join(counted, "phenotype", "left").join(total)
    return joined.select("phenotype", F.coalesce("cases", F.lit(0)).alias("cases"), (F.col("__n") - F.coalesce("__marked", F.lit(0))).alias("controls"))


def phenome_scan(marks: DataFrame, people: DataFrame, person: str, genotype: str, covariates: list[str], least: int = 20, rounds: int = 50) -> DataFrame:
    """phenotype, cases, controls, beta, se, p, p_bonferroni of logistic regressions on the genotype and covariates, for phenotypes with
    `least` cases and controls or more.

    All phenotypes are fitted at once. An iteration adds up the scores and informations of all people as if they were controls of every phenotype, a
    product of matrices for each batch of people, and sets right the marked ones, who are few; the driver gets a vector and a matrix
    of terms for each phenotype of the code list. Raises ArithmeticError without convergence (a separated outcome).
    """
    terms = [genotype, *covariates]
    q = len(terms) + 1
    rows = settled(people.select(person, *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(terms))).dropna())
    marked = settled(marks.join(rows, person).drop(person))
    sizes = phenome_counts(marked, rows, marked).filter((F.col("cases") >= least) & (F.col("controls") >= least)).orderBy("phenotype").collect()
    names = {r["phenotype"]: k for k, r in enumerate(sizes)}
    width = q + q * q

    def design(p: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(p)), *(p[f"x{i}"].to_numpy(float) for i in range(q - 1))])

    def summed(of: DataFrame, part) -> np.ndarray:
        """part: a frame and its terms -> sums by phenotype."""

        def run(frames):
            total = np.zeros((len(names), width))
            for p in frames:
                total += part(p, design(p))
            yield pd.DataFrame({"k": np.repeat(np.arange(len(names)), width), "j": np.tile(np.arange(width), len(names)), "v": total.ravel()})

        out = np.zeros((len(names), width))
        got = of.mapInPandas(run, "k int, j int, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).toPandas()
        out[got["k"], got["j"]] = got["v"]
        return out

    beta = np.zeros((len(names), q))
    beta[:, 0] = [np.log(r["cases"] / r["controls"]) for r in sizes]
    for _ in range(rounds if names else 0):
        now = beta.copy()

        def everybody(p, x, now=now):
            mu = 1 / (1 + np.exp(-np.clip(x @ now.T, -30, 30)))
            w = mu * (1 - mu)
            return np.column_stack([-(mu.T @ x), np.einsum("np,ni,nj->pij", w, x, x, optimize=True).reshape(len(names), -1)])

        def those_marked(p, x, now=now):
            k = p["phenotype"].map(names)
            x, case, k = x[k.notna()], p["case"].to_numpy()[k.notna()] == 1, k.dropna().to_numpy(int)
            mu = 1 / (1 + np.exp(-np.clip((x * now[k]).sum(axis=1), -30, 30)))
            # A case has x more in its score than a control; who is neither gives back what a control has.
            score = np.where(case, 1.0, mu)[:, None] * x
            information = np.where(case, 0.0, -mu * (1 - mu))[:, None, None] * x[:, :, None] * x[:, None, :]
            out = np.zeros((len(names), width))
            np.add.at(out, k, np.column_stack([score, information.reshape(len(k), -1)]))
            return out

        sums = summed(rows, everybody) + summed(marked, those_marked)
        information = sums[:, q:].reshape(-1, q, q)
        step = np.linalg.solve(information, sums[:, :q, None])[:, :, 0]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    else:
        if names:
            raise ArithmeticError("no convergence: an outcome may be separated")
    se = np.sqrt(np.linalg.inv(information)[:, 1, 1]) if names else []
    out = [(r["phenotype"], int(r["cases"]), int(r["controls"]), float(b), float(e), float(2 * N.NORMAL.cdf(-abs(b / e)))) for r, b, e in zip(sizes, beta[:, 1], se, strict=True)]
    fitted = marks.sparkSession.createDataFrame(out, "phenotype string, cases long, controls long, beta double, se double, p double")
    return fitted.withColumn("p_bonferroni", F.least(F.col("p") * len(out), F.lit(1.0)))
