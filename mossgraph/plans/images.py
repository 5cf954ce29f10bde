"""Registered queries of images, made of the bytes of every page, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images
from .retrieval import spread, table

#: Pixels of a row.
WIDE = 16


def drawn(pages):
    """page_id, png: each page's bytes as red, green and blue of its pixels, the last row filled up with zeros; the rows take turns
    with the format's five filters."""

    @F.pandas_udf("binary")
    def png(number, html):
        import numpy as np
        import pandas as pd

        out = []
        for k, body in zip(number, html):
            n = max(1, -(-len(body) // (3 * WIDE)))
            pixels = np.frombuffer(bytes(body).ljust(n * 3 * WIDE, b"\0"), dtype=np.uint8).reshape(n, WIDE, 3)
            out.append(images.encoded_png(pixels, (np.arange(n) + int(k)) % 5))
        return pd.Series(out)

    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    return pages.select("page_id", png(F.coalesce(F.col("page_id"), F.lit(0)), html).alias("png"))


def image_pixels(spark, sf_dir):
    """Size, sums of the colours, and a sum by place of the decoded pixels of each page's image."""
    found = images.decoded(drawn(spread(table(spark, sf_dir, "pages").select("page_id", "html"))), "page_id", "png", None)

    @F.pandas_udf("array<long>")
    def sums(pixels):
        import numpy as np
        import pandas as pd

        rows = [np.frombuffer(p, dtype=np.uint8).astype(np.int64) for p in pixels]
        return pd.Series([[*x.reshape(-1, 3).sum(axis=0).tolist(), int(x @ (np.arange(len(x)) % 251 + 1))] for x in rows])

    counted = found.select("page_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), sums("pixel_values").alias("s"))
    return counted.select("page_id", "width", "height", *[F.get("s", F.lit(k)).alias(name) for k, name in enumerate(["red", "green", "blue", "by_place"])])


def queries() -> dict:
    return {"image_pixels": image_pixels}


def oracle_sql() -> dict[str, str]:
    size = 3 * WIDE
    pick = lambda k: f"coalesce(sum(v) FILTER (i % 3 = {k}), 0)::BIGINT"
    return {
        "image_pixels": f"""WITH h AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h FROM pages), b AS (SELECT page_id, h, unnest(range(len(h) // 2)) AS i FROM h),
v AS (SELECT page_id, i, (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS v FROM b),
s AS (SELECT page_id, {pick(0)} AS red, {pick(1)} AS green, {pick(2)} AS blue, coalesce(sum(v * (i % 251 + 1)), 0)::BIGINT AS by_place FROM v GROUP BY 1)
SELECT page_id, {WIDE}::BIGINT AS width, greatest(1, (len(h) // 2 + {size - 1}) // {size})::BIGINT AS height, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, coalesce(by_place, 0) AS by_place FROM h LEFT JOIN s USING (page_id)"""
    }
