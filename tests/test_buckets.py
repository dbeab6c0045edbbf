"""The order-grain tables' buckets stay small enough for one task, whatever the data's size."""

from __future__ import annotations

import pytest

from tradewind.sources import warehouse


@pytest.mark.parametrize("mib", [48, 480])
def test_a_bucket_holds_few_rows(spark, tmp_path, mib):
    with open(tmp_path / "lineitem.parquet", "wb") as f:
        f.truncate(mib * 1024 * 1024)  # only its length counts
    assert warehouse.bucket_count(spark, str(tmp_path)) == mib // 8
