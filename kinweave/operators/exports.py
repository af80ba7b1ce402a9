"""What leaves the engine: the sheet of matches with its links, workbooks, listings."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names as N

# Columns of the record sheets that the cells of a match point to.
LEFT_TARGETS, LEFT_TARGETS_BY_SOURCE, RIGHT_TARGETS = "ABECF", "ABMCF", "ACDEHKI"
#: Rows a sheet of the format can have.
SHEET_ROWS = 1_048_576


def match_sheet(j: DataFrame, left_sheet: str = "Left", right_sheet: str = "Right", score: bool = False) -> DataFrame:
    """(death_place, a_id, b_id, side, cells, links): two rows per match, the left record above the right one.

    ``j`` is ``reports.joined`` with ``l_row`` and ``r_row``, the rows of the records in their own sheets; every cell
    links to its cell there, the year to the source where the source decided it.  ``score`` adds it to the left row.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    left = [text("l_full_name"), text("l_father"), N.year_part(text("l_byear")), N.place_part(text("l_place")), text("l_dyear")]
    right = [F.concat_ws(" ", "r_given", "r_surname"), *(text(f"r_{c}") for c in ("father", "byear", "place", "dyear", "circumstances", "dplace"))]
    at = lambda sheet, letters, row: F.array(*[F.concat(F.lit(f"'{sheet}'!{x}"), F.col(row).cast("string")) for x in letters])
    links = F.when(F.col("year_in_source"), at(left_sheet, LEFT_TARGETS_BY_SOURCE, "l_row")).otherwise(at(left_sheet, LEFT_TARGETS, "l_row"))
    cells = F.array(*left, F.lit(""), F.lit(""), F.format_string("%.2f", "score")) if score else F.array(*left)
    side = lambda n, c, k: F.struct(F.lit(n).alias("side"), c.alias("cells"), k.alias("links"))
    two = F.array(side(0, cells, links), side(1, F.array(*right), at(right_sheet, RIGHT_TARGETS, "r_row")))
    return j.select(F.col("r_dplace").alias("death_place"), "a_id", "b_id", F.explode(two).alias("x")).select("death_place", "a_id", "b_id", "x.*")


def sheet_order(rows: DataFrame, by_death_place: bool = False) -> DataFrame:
    return rows.orderBy(*(["death_place"] if by_death_place else []), "a_id", "b_id", "side")


def widths(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the width each column of a sheet needs, its longest value or name and five more."""
    return df.agg(*[(F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))) + 5).alias(c) for c in columns])


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _row(n: int, values: list, style: str = "") -> str:
    cells = "".join(f'<c r="{_letters(i)}{n}"{style} t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for i, v in enumerate(values))
    return f'<row r="{n}">{cells}</row>'


def _sheet(df: DataFrame) -> Iterator[str]:
    names = df.columns
    wide = widths(df, *names).first()
    yield '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>'
    yield "".join(f'<col min="{i + 1}" max="{i + 1}" width="{wide[i]}" customWidth="1"/>' for i in range(len(names)))
    yield "</cols><sheetData>" + _row(1, names, ' s="1"')
    for n, r in enumerate(df.toLocalIterator(), 2):
        if n > SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows; write one workbook per component")
        yield _row(n, list(r))
    yield "</sheetData></worksheet>"


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """One workbook with a sheet per frame: bold first row that stays in view, columns as wide as they need.

    Rows stream through the driver; a sheet cannot have more than the format allows.
    """
    space = 'xmlns="http://schemas.openxmlformats.org/package/2006'
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types {space}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'<Relationships {space}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {space}/relationships">{links}<Relationship Id="st" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                for part in _sheet(df):
                    out.write(part.encode())


def left_sheet_columns(left: DataFrame) -> DataFrame:
    """The left registry as its sheet: place and municipality apart, the municipality only behind a comma."""
    place = F.coalesce(F.col("`Place of Birth:`"), F.lit(""))
    kept: list[Column] = [F.col(f"`{c}`") for c in left.columns if c != "Place of Birth:"]
    return left.select(*kept, N.place_part(place).alias("Birth place"), N.sheet_municipality(place).alias("Birth municipality"))


def by_component(df: DataFrame, component: str, path: str) -> None:
    """Tab-separated files, one folder per component, in one pass."""
    df.write.partitionBy(component).option("sep", "\t").mode("errorifexists").csv(path)
