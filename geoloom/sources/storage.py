"""Where layers live: a folder, or a bucket of an S3-compatible store."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def s3a_settings(key_id: str, secret: str, account_id: str, bucket: str) -> dict[str, str]:
    """Hadoop settings for one bucket of an account's S3-compatible endpoint; nothing is set for other buckets."""
    base = f"fs.s3a.bucket.{bucket}"
    return {
        f"{base}.endpoint": f"https://{account_id}.r2.cloudflarestorage.com",
        f"{base}.access.key": key_id,
        f"{base}.secret.key": secret,
        f"{base}.path.style.access": "true",
        f"{base}.endpoint.region": "auto",
    }


def s3a_root(bucket: str, prefix: str = "") -> str:
    """Folder ``prefix`` of a bucket, or the whole bucket."""
    return "/".join(x for x in (f"s3a://{bucket}", prefix.strip("/")) if x)


def credentials(key_id: str | None, secret: str | None, account_id: str | None, bucket: str | None) -> tuple[str, ...]:
    """Given values, or those of the environment."""
    names = ("S3_KEY_ID", "S3_SECRET", "S3_ACCOUNT_ID", "S3_BUCKET_NAME")
    out = tuple(v or os.environ.get(n) for v, n in zip((key_id, secret, account_id, bucket), names))
    if missing := [n for v, n in zip(out, names) if not v]:
        raise ValueError(f"Missing credentials: {missing}")
    return out


class Layers:
    """Layers by name: ``{root}/{name}.parquet``, or tables registered for the purpose."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.tables = spark, root, {}

    def register(self, name: str, layer: DataFrame) -> None:
        self.tables[name] = layer

    def read(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.root is None:
            raise ValueError("No layers connected: call connect_local_database or connect_cloud_storage first")
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")
