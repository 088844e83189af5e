"""Folders of micro-batches: ``era=E/batch_id=N`` under a path.

Every batch writes a folder of its own, so a batch played again replaces what it wrote. The first batch
with rows of an era folds all before it into one summary there (batch id -1), so a reader opens one era:
what has been filed, once, and at most ``ERA`` batches. Batches without rows may leave no folder, and
whole eras may be left out.
"""

from podium.session import subfolders

ERA = 100  # batches that share a folder


def eras(spark, path):
    return sorted(int(n[4:]) for n in subfolders(spark, path) if n.startswith("era="))


def fold_past(spark, path, era, batch_id, summary, parts=()):
    """Write ``summary(era)`` of all before ``era`` there, if it is missing or may be half written.

    The eras before are complete, so the first batch of an era, played again, writes the same.
    """
    earlier = [e for e in eras(spark, path) if e < era]
    if not earlier:
        return
    folders = subfolders(spark, f"{path}/era={era}") if era in eras(spark, path) else []
    batches = [int(n[9:]) for n in folders if n.startswith("batch_id=")]
    if -1 not in batches or not any(0 <= b < batch_id for b in batches):
        file_batch(summary(earlier[-1]), path, era, -1, parts)


def file_batch(rows, path, era, batch_id, parts=()):
    """Write the folder of a batch, in place of what it may have written before."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(f"{path}/era={era}/batch_id={batch_id}")


def current_era(spark, path):
    """The last era that can be read: one with only its summary may still be being written."""
    found = eras(spark, path)
    if len(found) > 1 and set(subfolders(spark, f"{path}/era={found[-1]}")) <= {"batch_id=-1"}:
        return found[-2]
    return found[-1] if found else 0
