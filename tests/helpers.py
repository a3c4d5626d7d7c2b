"""Small observation rows for golden tests."""

from datetime import date

from quartermark.schemas import OBS_COLUMNS, schema


def obs_row(**kw):
    row = dict(
        geospatial="A", geospatial_codes="20001", geospatial_type="suburb", time_bucket=date(2025, 3, 1), dwelling_type="house", bedrooms="2",
        statistic="median", value=1.0, data_type="rental", data_frequency="quarterly", source_file="vendor.xlsx", source_sheet="s", cell="A1",
    )
    row.update(kw)
    row.setdefault("dwelling_class", f"{row['dwelling_type']}-{row['bedrooms']}")
    if row["data_type"] == "sales":
        row.update(time_bucket=date(row["time_bucket"].year, 1, 1), data_frequency="annual")
    return tuple(row[c] for c in OBS_COLUMNS)


def obs_frame(spark, rows):
    return spark.createDataFrame([obs_row(**r) for r in rows], schema("rental_sales"))


def rental(dwelling, bedrooms, median=None, count=None, **kw):
    out = []
    if median is not None:
        out.append(dict(dwelling_type=dwelling, bedrooms=bedrooms, value=float(median), **kw))
    if count is not None:
        out.append(dict(dwelling_type=dwelling, bedrooms=bedrooms, value=float(count), statistic="count", **kw))
    return out


def sale(dwelling, price, **kw):
    return dict(dwelling_type=dwelling, bedrooms="all", value=float(price), data_type="sales", **kw)


def square(x, y, w=1.0, h=1.0):
    return [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]]
