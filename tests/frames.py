"""Small input frames shared by the test modules."""

import datetime as dt

from saiflow import schemas


def posts_df(spark, rows):
    """Inline posts frame: (code, 'yyyy-MM-dd HH:mm:ss' text, title, author)."""
    data = [(c, dt.datetime.fromisoformat(t) if t else None, ti, a) for c, t, ti, a in rows]
    return spark.createDataFrame(data, schemas.POSTS)
