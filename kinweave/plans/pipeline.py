"""Presets, sweeps and whole runs: inputs standardised once, many settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import corpora as C
from kinweave.operators import extract as E
from kinweave.operators import linkage as L
from kinweave.operators import reports as R
from kinweave.plans.runtime import cut
from kinweave.sources import registries as io

PRESETS = {
    "main": L.Options(normalise=True, check_father=True, check_year=True, check_place=True),
    "relaxed": L.Options(normalise=True, key_father=True, key_year=True, key_place=True, check_year=True, check_place=True, empties=True),
    "fuzzy": L.Options(normalise=True, check_father=True, check_year=True, check_place=True, method="ld", threshold=2, block_letters=2, fuzzy_father=True),
}
#: Rules of the programs that link the left registry with lexicons and certificates.
ENTRY_PRESETS = {"first_lexicon": C.FIRST_LEXICON, "second_lexicon": C.SECOND_LEXICON, "certificates": C.CERTIFICATES}


@dataclass(frozen=True)
class Pipeline:
    """Filter, link, and tag the matches of each setting."""

    left: DataFrame
    right: DataFrame
    leave_out_places: bool = True

    def _inputs(self) -> tuple[DataFrame, DataFrame]:
        right = L.without_left_out_places(self.right) if self.leave_out_places else self.right
        return self.left, right

    def run(self, options: L.Options) -> DataFrame:
        return L.link(*self._inputs(), options)

    def sweep(self, settings: dict[str, L.Options]) -> DataFrame:
        """Matches of every setting, tagged; names are prepared once for all settings."""
        left, right = self._inputs()
        if any(o.normalise for o in settings.values()):
            left, right = L.with_prepared_names(left, right)
        left, right = cut(left), cut(right)
        out = None
        for name, o in settings.items():
            rows = L.link(left, right, o).withColumn("setting", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        return out

    def export(self, options: L.Options, folder: str, separator: str = "|") -> dict[str, int]:
        """Matches, listing and report written to a folder; the number of rows of each."""
        matches = cut(self.run(options))
        j = R.joined(matches, self.left, self.right).withColumn("r_full_name", F.concat_ws(" ", "r_given", "r_surname"))
        written = {
            "matches": matches,
            "listing": io.match_lines(j, ["l_full_name", "l_father", "l_byear", "l_place"], ["r_full_name", "r_father", "r_byear", "r_place"], separator),
            "report": R.report_lines(R.full_report(j, options.sort_parts, options.normalise)),
        }
        matches.write.parquet(os.path.join(folder, "matches"))
        for name in ("listing", "report"):
            written[name].coalesce(1).write.text(os.path.join(folder, name))
        return {k: df.count() for k, df in written.items()}


def tolerance_settings(base: L.Options, upto: int) -> dict[str, L.Options]:
    return {f"m{m}": replace(base, max_year_gap=m) for m in range(upto + 1)}


def method_settings(base: L.Options, distances: int = 3, upto: int = 5) -> dict[str, L.Options]:
    """Exact names and Levenshtein distances up to ``distances``, each at year tolerances up to ``upto``."""
    near = {f"ld{t}_{k}": replace(o, method="ld", threshold=t, block_letters=2, fuzzy_father=True) for t in range(1, distances + 1) for k, o in tolerance_settings(base, upto).items()}
    return {f"exact_{k}": o for k, o in tolerance_settings(base, upto).items()} | near


def build_right_registry(spans: DataFrame) -> DataFrame:
    """Spans of scanned books (component, file, page, ord, x0, y1, font_size, text) to person records with their places in the books.

    All components in one pass; broken lines are put together, lines parsed, and every record gets its page and column.
    """
    keyed = spans.withColumn("file", F.concat_ws("/", "component", "file"))
    lines, places = E.indented_lines(E.merged_lines(E.classified_spans(keyed)))
    records = E.with_locations(E.parsed_records(lines), places)
    named = records.withColumns({"component": F.substring_index("file", "/", 1), "File": F.substring_index("file", "/", -1), "Page": F.col("page").cast("string"), "Column": F.col("column").cast("string")})
    return named.select("component", *io.RIGHT_FIELDS)


def build_components(spark: SparkSession, spans: DataFrame, folder: str) -> list[str]:
    """Writes the records of each component to its own folder; components that are there already are left out."""
    done = []
    for (name,) in spans.select("component").distinct().orderBy("component").collect():
        target = os.path.join(folder, name)
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            io.write_right(build_right_registry(spans.filter(F.col("component") == name)), target)
            done.append(name)
    return done
