"""The profiling analyses as one object with stored results."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from ..sources.io import export_results, nan_to_null
from . import profile as P
from .sampling import safe_sample

ID_LIMITS = {"max_unique_ratio": 0.95, "correlation_threshold": 0.98, "cramers_v_threshold": 0.90, "show_top": 25}


class Analyzer:
    """Analyses of a table and, if named, its outcome. Methods return small tables and keep them in ``results``.

    The table is cached once; analyses after :meth:`analyze_missing_values` see its stand-ins for missing values as null.
    """

    def __init__(self, data: DataFrame, outcome_feature: str | None = None, log_level: str = "INFO"):
        if outcome_feature is not None and outcome_feature not in data.columns:
            raise ValueError(f"no column {outcome_feature}")
        self.data, self.outcome_feature, self.results = nan_to_null(data).persist(StorageLevel.MEMORY_AND_DISK), outcome_feature, {}
        self.log = logging.getLogger("quartzite")
        self.log.setLevel(log_level)

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _types(self) -> dict[str, str]:
        if "feature_types" not in self.results:
            self.analyze_feature_types()
        return self.results["feature_types"]["feature_type_map"]

    def _of(self, *kinds: str) -> list[str]:
        return [c for c, k in self._types().items() if k in kinds]

    def _numbers(self) -> list[str]:
        plain = set(P.numeric_columns(self.data))
        return [c for c in self._of("numeric", "binary", "categorical") if c in plain and c != self.outcome_feature]

    def analyze_feature_types(self, sample_size: int = 10, **_) -> dict:
        types = P.feature_types(self.data, self.outcome_feature)
        groups: dict[str, list[str]] = {}
        for c, k in types.items():
            groups.setdefault(k, []).append(c)
        head = self.data.limit(sample_size).collect()
        samples = {c: [r[c] for r in head if r[c] is not None] for c in types}
        self.results["feature_types"] = {"feature_type_map": types, "grouped_features": groups, "type_counts": {k: len(v) for k, v in groups.items()}, "total_features": len(types), "sample_data": samples}
        return self.results["feature_types"]

    def report_type_issues(self) -> list[dict]:
        """Numbers in the range of Excel's serial dates."""
        kinds = dict(self.data.dtypes)
        numbers = [c for c in self._of("datetime") if c in P.numeric_columns(self.data)]
        return [{"feature": c, "issue": "EXCEL_SERIAL_DATE", "type": kinds[c]} for c in P.serial_dates(self.data, numbers)]

    def inspect_feature(self, feature: str | Sequence[str]) -> dict:
        names = [feature] if isinstance(feature, str) else list(feature)
        missing = {r["feature"]: r for r in self._rows(P.missing_values(self.data, names))}
        unique = {r["feature"]: r["n_unique"] for r in self._rows(P.cardinality(self.data, names))}
        n = self.data.count()
        out = {}
        for c in names:
            kind = dict(self.data.dtypes)[c]
            out[c] = {"type": P.single_type(self.data, c, self.outcome_feature), "dtype": kind, "total": n, "missing": missing[c]["missing"], "missing_pct": missing[c]["pct"], "unique": unique[c]}
            if c in P.numeric_columns(self.data):
                out[c]["statistics"] = self._rows(P.describe(self.data, [c]))[0]
            elif kind in ("date", "timestamp", "timestamp_ntz"):
                out[c]["datetime_info"] = self._rows(self.data.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.datediff(F.max(c), F.min(c)).alias("days")))[0]
            else:
                out[c]["value_distribution"] = self._rows(P.value_counts(self.data, [c]).orderBy(F.desc("n"), "value").limit(20).select("value", "n"))
        return out[names[0]] if isinstance(feature, str) else out

    def analyze_missing_values(self, threshold: float = 0.5, detect_special_codes: bool = True, convert_special_to_nan: bool = True, strip_whitespace: bool = True, exclude: Sequence[str] = (), **_) -> dict:
        df, codes = self.data, []
        if strip_whitespace:
            df = df.withColumns({c: S.trim_if_content(F.col(f"`{c}`")) for c in P.text_columns(df)})
        if detect_special_codes:
            codes = self._rows(P.special_codes(df, exclude=exclude).groupBy("feature", "kind").agg(F.sum("n").alias("n")))
            if convert_special_to_nan:
                df = P.nulled_special(df, exclude)
        if df is not self.data:
            old, self.data = self.data, df.persist(StorageLevel.MEMORY_AND_DISK)
            self.data.count()
            old.unpersist()
        types = self._types()
        table = self._rows(P.missing_values(self.data))
        n = self.data.count()
        self.results["missing_values"] = {
            "total_missing": sum(r["missing"] for r in table),
            "total_cells": n * len(table),
            "missing_by_feature": {r["feature"]: {"count": r["missing"], "percentage": r["pct"], "severity": r["severity"], "feature_type": types.get(r["feature"])} for r in table if r["missing"]},
            "above_threshold": [r["feature"] for r in table if r["pct"] > 100 * threshold],
            "above_90": [r["feature"] for r in table if r["pct"] > 90],
            "special_codes_detected": codes,
        }
        return self.results["missing_values"]

    def analyze_low_variance(self, variance_threshold: float = 0.01) -> dict:
        cols = self._numbers()
        table = self._rows(P.variance(self.data, cols, variance_threshold)) if cols else []
        self.results["low_variance"] = {"variance_by_feature": {r["feature"]: {"variance": r["variance"], "std_dev": r["std_dev"], "range": r["value_range"]} for r in table}, "low_variance": [r["feature"] for r in table if r["status"] == "low"], "constant": [r["feature"] for r in table if r["status"] == "constant"]}
        return self.results["low_variance"]

    def analyze_sparse_categorical(self, sparse_threshold: float = 0.01) -> dict:
        cols = [c for c in self._of("categorical", "binary") if c in P.text_columns(self.data)]
        table = self._rows(P.sparse_categories(self.data, cols, sparse_threshold)) if cols else []
        self.results["sparse_categorical"] = {"sparse_by_feature": {r["feature"]: r["sparse"] for r in table if r["sparse"]}, "dominance_by_feature": {r["feature"]: {"value": r["dominant"], "share": r["dominance"]} for r in table}}
        return self.results["sparse_categorical"]

    def analyze_correlations(self, correlation_threshold: float = 0.8, max_features_plot: int = 30) -> dict:
        cols = self._numbers()
        pairs = self._rows(P.correlations(self.data, cols)) if len(cols) > 1 else []
        known = [r for r in pairs if r["correlation"] is not None]
        high = sorted((r for r in known if r["abs_correlation"] >= correlation_threshold), key=lambda r: -r["abs_correlation"])
        most = {c: max((r["abs_correlation"] for r in known if c in (r["feature_1"], r["feature_2"])), default=0.0) for c in cols}
        mean = {c: sum(r["abs_correlation"] for r in known if c in (r["feature_1"], r["feature_2"])) / max(1, len(cols) - 1) for c in cols}
        self.results["correlations"] = {"matrix": pairs, "high_correlations": high, "feature_max_corr": most, "features_to_remove": list(dict.fromkeys(r["feature_2"] for r in high)), "plot_features": sorted(cols, key=lambda c: -mean[c])[:max_features_plot]}
        return self.results["correlations"]

    def analyze_outcome_correlation(self) -> dict:
        if not self.outcome_feature:
            return {"error": "no outcome feature"}
        try:
            cols = self._numbers()
            numbers = self._rows(P.point_biserial(self.data, self.outcome_feature, cols)) if cols else []
        except ValueError as e:
            return {"error": str(e)}
        texts = [c for c in self._of("categorical", "binary") if c in P.text_columns(self.data) and c != self.outcome_feature]
        self.results["outcome_correlation"] = {"point_biserial": numbers, "cramers_v": self._rows(P.cramers_v(self.data, self.outcome_feature, texts)) if texts else []}
        return self.results["outcome_correlation"]

    def detect_data_leakage_risk(self, max_unique_ratio: float = 0.95, correlation_threshold: float = 0.98, cramers_v_threshold: float = 0.90, show_top: int = 25, strict_keywords: bool = False) -> dict:
        y = self.outcome_feature
        if not y:
            raise ValueError("an outcome feature is needed")
        same = self._rows(P.leak_exact(self.data, y))
        exact = [{"feature": r["feature"]} for r in same if r["exact"]]
        near = [{"feature": r["feature"]} for r in same if r["near"] and not r["exact"]]
        found = self.analyze_outcome_correlation()
        numbers = [r for r in found.get("point_biserial", []) if abs(r["r"]) >= correlation_threshold]
        texts = [c for c in P.text_columns(self.data) if c != y]
        assoc = [r for r in self._rows(P.leakage_v(self.data, y, texts)) if r["n"] >= 50 and r["v"] >= cramers_v_threshold] if texts else []
        unique = {r["feature"]: r["unique_ratio"] for r in self._rows(P.cardinality(self.data))}
        ids = [{"feature": c} for c in self.data.columns if c != y and unique[c] >= max_unique_ratio and P.leak_determinism(self.data, c, y).first().deterministic]
        self.results["leakage_risk"] = {
            "exact_duplicates": exact[:show_top], "near_duplicates": near[:show_top], "high_numeric_correlations": sorted(numbers, key=lambda r: -abs(r["r"]))[:show_top], "high_categorical_associations": sorted(assoc, key=lambda r: -r["v"])[:show_top],
            "id_like_determinism": ids[:show_top], "name_based_suspects": [{"feature": c} for c in P.leak_names(self.data.columns, y, strict_keywords)][:show_top],
            "thresholds": {"max_unique_ratio": max_unique_ratio, "correlation": correlation_threshold, "cramers_v": cramers_v_threshold},
        }
        return self.results["leakage_risk"]

    def score_feature_quality(self, missing_weight: float = 0.35, uniqueness_weight: float = 0.20, variance_weight: float = 0.20, outlier_weight: float = 0.10, leakage_penalty_weight: float = 0.15) -> list[dict]:
        leak = self.results.get("leakage_risk", {})
        leaking = sorted({r["feature"] for rows in leak.values() if isinstance(rows, list) for r in rows})
        weights = (missing_weight, uniqueness_weight, variance_weight, outlier_weight, leakage_penalty_weight)
        table = self._rows(P.feature_quality(self.data, self.outcome_feature, weights, leaking).orderBy(F.desc("quality_score"), "feature"))
        self.results["feature_quality"] = {"table": table}
        return table

    def analyze_data_alerts(self) -> dict:
        table = self._rows(P.sorted_alerts(P.alerts(self.data, self.outcome_feature)))
        self.results["data_alerts"] = {"table": table, "counts": {s: sum(r["severity"] == s for r in table) for s in ("HIGH", "MEDIUM", "LOW")}}
        return self.results["data_alerts"]

    def analyze_bivariate_relationships(self, feature_pairs: Sequence[tuple[str, str]] | None = None, auto_select_top: int = 5) -> dict:
        if feature_pairs is None:
            high = self.results.get("correlations") or self.analyze_correlations()
            pairs = sorted((r for r in high["matrix"] if r["correlation"] is not None), key=lambda r: -r["abs_correlation"])
            feature_pairs = [(r["feature_1"], r["feature_2"]) for r in pairs[:auto_select_top]]
            texts = [c for c in self._of("categorical", "binary") if c in P.text_columns(self.data)]
            feature_pairs += list(combinations(texts, 2))[: max(0, auto_select_top - len(feature_pairs))]
        numbers, out = set(P.numeric_columns(self.data)), {}
        for a, b in feature_pairs:
            if a in numbers and b in numbers:
                found = {"type": "numeric_numeric"} | self._rows(self.data.agg(P.pearson(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias("correlation"), F.count_if(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).alias("n")))[0] | self._rows(P.trend(self.data, a, b).drop("n"))[0]
            elif a in numbers or b in numbers:
                rows = self._rows(P.group_stats(self.data, *((a, b) if a in numbers else (b, a))))
                found = {"type": "numeric_categorical", "groups": rows} if sum(r["n"] for r in rows) >= 10 else {"error": "fewer than ten rows have both"}
            else:
                rows = self._rows(P.cramers_v_corrected(self.data, a, b))
                found = {"type": "categorical_categorical"} | (rows[0] if rows else {"n": 0})
            out[f"{a}_vs_{b}"] = found
        self.results["bivariate"] = out
        return out

    def run_all_analyses(self) -> dict:
        """In order: types, missing values, variance, sparsity, correlations, outcome, leakage, quality, alerts."""
        self.analyze_feature_types()
        self.analyze_missing_values()
        self.analyze_low_variance()
        self.analyze_sparse_categorical()
        self.analyze_correlations()
        if self.outcome_feature:
            self.analyze_outcome_correlation()
            self.detect_data_leakage_risk()
            self.score_feature_quality()
        self.analyze_data_alerts()
        return self.results

    def get_summary(self) -> dict:
        return {"rows": self.data.count(), "columns": len(self.data.columns), "outcome_feature": self.outcome_feature, "analyses": sorted(self.results), "type_counts": self.results.get("feature_types", {}).get("type_counts", {})}

    def export_results(self, path: str, fmt: str = "json") -> None:
        export_results(self.results, path, fmt)

    @staticmethod
    def safe_sample_dataset(data: DataFrame, target: str | None = None, max_rows: int = 500_000, random_state: int = 42, rid: str = "_rid") -> dict:
        from ..sources.io import with_row_id

        keyed = data if rid in data.columns else with_row_id(data)
        n = data.count()
        sample = safe_sample(keyed, target, max_rows, rid, random_state)
        sample = sample if rid in data.columns else sample.drop(rid)
        return {"data": sample, "info": {"original_rows": n, "max_rows": max_rows, "sampled": n > max_rows, "sample_rate": min(1.0, max_rows / max(1, n)), "strategy": "all" if n <= max_rows else "stratified" if target else "random"}}
