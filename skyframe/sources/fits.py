"""FITS files of maps, coefficients, spectra, windows and weights, on the data source of ``fits_source``.

Tables are read in ranges of rows by many tasks, and written in ordered parts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import pixel as P
from skyframe.operators.maps import mask_good, unseen_to_null

from .fits_source import FitsDataSource, Unit, _system, fs, header_of

# Names of a map's and a spectrum's fields, by their number.
MAP_NAMES = {1: ["TEMPERATURE"], 2: ["Q_POLARISATION", "U_POLARISATION"], 3: ["TEMPERATURE", "Q_POLARISATION", "U_POLARISATION"], 6: ["II", "IQ", "IU", "QQ", "QU", "UU"]}
CL_NAMES = ["TEMPERATURE", "GRADIENT", "CURL", "G-T", "C-T", "C-G"]
#: Elements a cell of a full map's fields has where they divide the map.
CELL = 1024
#: Pixels a partition of a written map has; a multiple of CELL.
PART = 1 << 20


def _source(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FitsDataSource)
    return spark.read.format("fits").options(path=path, **options).load()


def read_header(path: str, hdu: int | str = 1) -> dict:
    """A unit's keywords and values."""
    return header_of(path, hdu).header


def _names(unit: Unit, fields, skip: int = 0) -> list[str]:
    names = [f.name for f in unit.fields()][skip:]
    fields = range(len(names)) if fields is None else [fields] if isinstance(fields, (int, str)) else fields
    return [f if isinstance(f, str) else names[f] for f in fields]


def read_map(spark: SparkSession, path: str, field: int | str | tuple | None = 0, hdu: int | str = 1, nest: bool | None = False, partition_bytes: int = 32 << 20) -> DataFrame:
    """(ipix, value) of a map file, in RING order or as asked (None: as stored); bad values are null, pixels absent from a partial file absent.

    ``field``: a number or name; of several or None (all), the columns are named as in the file.
    """
    unit = header_of(path, hdu)
    head = unit.header
    text = lambda key: str(head.get(key, "")).strip().upper()
    partial = text("OBJECT") == "PARTIAL" or text("INDXSCHM") == "EXPLICIT"
    names = _names(unit, field, int(partial))
    explicit = [unit.fields()[0].name] if partial else []
    rows = _source(spark, path, hdu=str(hdu), fields=",".join(explicit + names), flatten="true", partition_bytes=str(partition_bytes))
    per_cell = next(f.count for f in unit.fields() if f.name == names[0])
    size = head["NAXIS2"] * per_cell
    nside = head.get("NSIDE") or math.isqrt(size // 12)
    if not partial and size != 12 * nside * nside:
        raise ValueError(f"{size} values are no map of nside {nside}")
    pix = F.col(f"`{explicit[0]}`").cast("long") if partial else F.col("row") + int(head.get("FIRSTPIX") or 0)
    if nest is not None and text("ORDERING").startswith("NEST") != nest:
        pix = (P.ring2nest if nest else P.nest2ring)(nside, pix)
    kinds = dict(rows.dtypes)
    value = lambda n: unseen_to_null(F.col(f"`{n}`")) if kinds[n] in ("float", "double") else F.col(f"`{n}`")
    one = isinstance(field, (int, str))
    return rows.select(pix.alias("ipix"), *[value(n).alias("value" if one else n) for n in names])


def write_map(sky: DataFrame, path: str, nside: int, nest: bool = False, partial: bool = False, names: list[str] | None = None, units: list[str] | str | None = None, coord: str | None = None, cards: tuple = (), cells: bool = True, overwrite: bool = False) -> None:
    """One file of a map (ipix, values...): every other column is a field, in its own type.

    A full map has every pixel: nulls and absent ones are bad, which integer
    fields can't say.  A partial one has the pixels whose first value is good.
    ``names``, ``units``, ``cards`` ((key, value, comment)...): what the header
    says besides; ``cells``: whether fields of a full map stand in cells of 1,024.
    """
    columns = [c for c in sky.columns if c != "ipix"]
    names = names or MAP_NAMES.get(len(columns), [f"COLUMN_{i}" for i in range(1, len(columns) + 1)])
    if len(names) != len(columns):
        raise ValueError("there must be a name for each field")
    npix, kinds = 12 * nside * nside, dict(sky.dtypes)
    # The keywords by which readers of this format know the scheme.
    own = [["PIXTYPE", "HEALPIX", "pixelisation"], ["ORDERING", "NESTED" if nest else "RING", "order of pixels"], ["NSIDE", nside, "resolution"]]
    own += [] if partial else [["FIRSTPIX", 0, "first pixel"], ["LASTPIX", npix - 1, "last pixel"]]
    own += [["INDXSCHM", "EXPLICIT" if partial else "IMPLICIT", "indexing"], ["OBJECT", "PARTIAL" if partial else "FULLSKY", "coverage"]]
    own += [["COORDSYS", coord, "frame"]] if coord else []
    options = {"cards": json.dumps(own + [list(c) for c in cards])}
    units = [units] * len(columns) if isinstance(units, str) or units is None else list(units)
    value = lambda c: F.coalesce(F.col(c), F.lit(P.UNSEEN).cast(kinds[c])) if kinds[c] in ("float", "double") else F.col(c)
    if partial:
        good = sky.where(F.col(columns[0]).isNotNull() & mask_good(F.col(columns[0]).cast("double")))
        if good.isEmpty():
            raise ValueError("a partial map needs a good pixel")
        rows = good.select(F.col("ipix").cast("int" if npix < 1 << 31 else "long").alias("PIXEL"), *[value(c).alias(n) for c, n in zip(columns, names, strict=True)])
        rows = rows.repartitionByRange("PIXEL").sortWithinPartitions("PIXEL")
        units = [None, *units]
    else:
        repeat = CELL if cells and npix > CELL and npix % CELL == 0 else 1
        options |= {"repeat": str(repeat), "rows": str(npix)}
        grid = sky.sparkSession.range(npix).select(F.col("id").alias("ipix")).join(sky, "ipix", "left")
        part = F.floor(F.col("ipix") / PART)
        rows = grid.repartitionByRange(-(-npix // PART), part).sortWithinPartitions("ipix").select(*[value(c).alias(n) for c, n in zip(columns, names, strict=True)])
    _written(rows, path, overwrite, units=json.dumps(units), **options)


def _written(frame: DataFrame, path: str, overwrite: bool, add: bool = False, **options) -> None:
    system, at = _system(path)
    if not add and not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
        raise OSError(f"{path} is there already")
    frame.sparkSession.dataSource.register(FitsDataSource)
    frame.write.format("fits").options(path=path, **options).mode("append" if add else "overwrite").save()


def _by_degree(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(l, column, cl) of fields, a row each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("cl")) for c in columns])
    return rows.select(F.col("row").cast("int").alias("l"), F.inline(pairs))


def read_cl(spark: SparkSession, path: str, hdu: int | str = 1) -> DataFrame:
    """(l, column, cl): all columns of a spectra table, binary or ASCII."""
    rows = _source(spark, path, hdu=str(hdu), flatten="true")
    return _by_degree(rows, rows.columns[1:])


def write_cl(cl: DataFrame, path: str, names: list[str] | None = None, cards: tuple = (), overwrite: bool = False) -> None:
    """One file of spectra (l, columns...), a row for each degree from 0 to the last; absent ones are 0."""
    columns = [c for c in cl.columns if c != "l"]
    names = names or CL_NAMES[: len(columns)] + [f"COLUMN_{i}" for i in range(len(CL_NAMES) + 1, len(columns) + 1)]
    if len(names) != len(columns):
        raise ValueError("there must be a name for each spectrum")
    top = cl.agg(F.max("l")).first()[0]
    grid = cl.sparkSession.range((-1 if top is None else top) + 1).select(F.col("id").cast("int").alias("l")).join(cl, "l", "left")
    rows = grid.repartitionByRange("l").sortWithinPartitions("l")
    _written(rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, names, strict=True)]), path, overwrite, cards=json.dumps([list(c) for c in cards]))


def read_alm(spark: SparkSession, path: str, hdu: int | str | tuple = 1) -> DataFrame:
    """(l, m, re, im) of a coefficient file, whose index is l * l + l + m + 1; of several units, with their place as ``comp``."""
    if isinstance(hdu, (tuple, list)):
        parts = [read_alm(spark, path, h).select(F.lit(k).alias("comp"), "*") for k, h in enumerate(hdu)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out
    unit = header_of(path, hdu)
    index, real, imag = _names(unit, None)[:3]
    rows = _source(spark, path, hdu=str(hdu), fields=f"{index},{real},{imag}", flatten="true")
    at = rows.select(F.col(f"`{index}`").cast("long").alias("i"), F.col(f"`{real}`").cast("double").alias("re"), F.col(f"`{imag}`").cast("double").alias("im"))
    at = at.withColumn("l", P.isqrt(F.col("i") - 1)).withColumn("m", F.col("i") - F.col("l") * F.col("l") - F.col("l") - 1)
    m = F.when(F.col("m") >= 0, F.col("m")).otherwise(F.raise_error(F.lit("a coefficient has a negative order")))
    return at.select(F.col("l").cast("int").alias("l"), m.cast("int").alias("m"), "re", "im")


def write_alm(alm: DataFrame, path: str, lmax: int | None = None, mmax: int | None = None, single: bool = False, overwrite: bool = False) -> None:
    """One file of coefficients (l, m, re, im), or with ``comp`` a unit for each; up to a degree and order; ``single``: as 32-bit floats."""
    comps = [r.comp for r in alm.select("comp").distinct().orderBy("comp").collect()] if "comp" in alm.columns else [None]  # a unit each
    kind = "float" if single else "double"
    for k, comp in enumerate(comps):
        own = alm if comp is None else alm.where(F.col("comp") == comp)
        own = own if lmax is None else own.where(F.col("l") <= lmax)
        own = own if mmax is None else own.where(F.col("m") <= mmax)
        index = (F.col("l") * F.col("l") + F.col("l") + F.col("m") + 1).cast("int").alias("index")
        rows = own.select(index, F.col("re").cast(kind).alias("real"), F.col("im").cast(kind).alias("imag")).repartitionByRange("index").sortWithinPartitions("index")
        _written(rows, path, overwrite, add=k > 0, units=json.dumps(["l*l+l+m+1", "unknown", "unknown"]))


# --- windows and weights ---------------------------------------------------
def read_pixwin(spark: SparkSession, path: str, lmax: int | None = None) -> DataFrame:
    """(l, t, p): a pixel window, of temperature and of polarisation (null where the file has none); l from 0."""
    rows = _source(spark, path, flatten="true")
    names = rows.columns[1:]
    p = F.col(f"`{names[1]}`").cast("double") if len(names) > 1 else F.lit(None).cast("double")
    out = rows.select(F.col("row").cast("int").alias("l"), F.col(f"`{names[0]}`").cast("double").alias("t"), p.alias("p"))
    return out if lmax is None else out.where(F.col("l") <= lmax)


def read_ring_weights(spark: SparkSession, path: str) -> DataFrame:
    """(ring, w) of a file of ring weights less 1, rings from 1; for ``map2alm(rings=...)``."""
    rows = _source(spark, path, flatten="true")
    return rows.select((F.col("row") + 1).cast("int").alias("ring"), F.col(f"`{rows.columns[1]}`").cast("double").alias("w"))


def read_pixel_weights(spark: SparkSession, path: str) -> DataFrame:
    """(index, w) of a file of folded pixel weights less 1; for ``unfolded_weights``."""
    rows = _source(spark, path, flatten="true")
    return rows.select(F.col("row").alias("index"), F.col(f"`{rows.columns[1]}`").cast("double").alias("w"))


def format_letter(kind: str) -> str | None:
    """A binary table's letter for a Spark type; null where there is none."""
    # What the format calls them.
    return {"boolean": "L", "tinyint": "I", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "A"}.get(kind)
