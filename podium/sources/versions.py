"""Tables that are replaced as a whole: readers see the old version or the new one, never half of one.

A version is a folder of its own. It counts once an empty file with its number lies beside it, which a
store creates in one step; a writer that fails before leaves the last version in place. Readers hold the
folder they found, so a version stays readable until it is cleared.
"""

from podium.session import subfolders

MARK, FOLDER = "_committed-", "v="


def _store(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _committed(spark, path):
    """The numbers of the committed versions, ascending."""
    store, place = _store(spark, path)
    if not store.exists(place):
        return []
    names = [f.getPath().getName() for f in store.listStatus(place) if f.isFile()]
    return sorted(int(n[len(MARK) :]) for n in names if n.startswith(MARK))


def publish_version(spark, path, write):
    """Let ``write(folder)`` fill a new folder under ``path``, then make it the current version."""
    begun = [int(n[len(FOLDER) :]) for n in subfolders(spark, path) if n.startswith(FOLDER)]
    number = max([0, *begun, *_committed(spark, path)]) + 1
    folder = f"{path}/{FOLDER}{number}"
    write(folder)
    store, _ = _store(spark, path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}{number}")
    if not store.createNewFile(mark):
        raise FileExistsError(f"version {number} of {path} was published by another writer")
    return folder


def current_version(spark, path):
    """The folder of the last committed version; None where there is none."""
    numbers = _committed(spark, path)
    return f"{path}/{FOLDER}{numbers[-1]}" if numbers else None


def clear_versions(spark, path, keep=2):
    """Delete all but the last ``keep`` committed versions, and what failed writers left before them."""
    numbers = _committed(spark, path)
    if len(numbers) < keep or keep < 1:
        return
    least = numbers[-keep]
    store, _ = _store(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for number in numbers:
        if number < least:  # no reader finds a version from here on
            store.delete(hadoop(f"{path}/{MARK}{number}"), False)
    for name in subfolders(spark, path):
        if name.startswith(FOLDER) and int(name[len(FOLDER) :]) < least:
            store.delete(hadoop(f"{path}/{name}"), True)


def existing(spark, paths):
    """Those of ``paths`` that exist."""
    found = []
    for path in paths:
        store, place = _store(spark, path)
        if store.exists(place):
            found.append(path)
    return found
