"""Settings files: nested names, lists and plain values, one a line, by indentation."""

from __future__ import annotations

from pyspark.sql import SparkSession


def flatten(text: str) -> dict[str, str]:
    """Dotted names to values as text. Raises ValueError for a line that is neither a name, a name with a value, nor a list's item."""
    out: dict[str, str] = {}
    path: list[tuple[int, str]] = []  # indentation and name of the open levels
    items: dict[str, int] = {}

    def put(name: str, value: str) -> None:
        if value.startswith("[") and value.endswith("]"):
            for k, x in enumerate(x.strip() for x in value[1:-1].split(",") if x.strip()):
                out[f"{name}.{k}"] = x.strip("'\"")
        else:
            out[name] = value.strip("'\"")

    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth, body = len(bare) - len(bare.lstrip()), bare.strip()
        item = body.startswith("- ")
        while path and (path[-1][0] > depth or (path[-1][0] == depth and not item)):
            path.pop()
        above = ".".join(n for _, n in path)
        if item:
            k = items[above] = items.get(above, -1) + 1
            put(f"{above}.{k}", body[2:].strip())
            continue
        name, mark, value = body.partition(":")
        if not mark:
            raise ValueError(f"not a setting: {line!r}")
        full = f"{above}.{name.strip()}" if above else name.strip()
        if value.strip():
            put(full, value.strip())
        else:
            path.append((depth, name.strip()))
    return out


def load_config(spark: SparkSession, path: str) -> dict[str, str]:
    """Settings of a file on any file system that Spark reads; a settings file is small."""
    return flatten("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
