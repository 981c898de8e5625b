"""Written steps: whoever still reads one after it was discarded gets an error, not an empty result."""

import pytest

from sheetwise.runtime import discard, materialize


def test_discarded_steps_cannot_be_read(spark):
    step = materialize(spark.range(10).withColumnRenamed("id", "k"), "steps")
    later = step.groupBy().sum("k")
    assert step.count() == 10
    discard(step)
    for reader in (later, step, step.filter("k > 3")):
        with pytest.raises(Exception, match="(?i)file"):
            reader.collect()
