"""Job settings (data path, column names, ignored columns, response) and the label spec."""

from __future__ import annotations

from dataclasses import dataclass, field


# The original job's property names and the keys they mean here.
KEY_ALIASES = {
    "CHURN_TRAIN_FILE_PATH": "path",
    "schemaString": "columns",
    "ignoredCols": "ignored",
    "response_column": "response",
}


@dataclass(frozen=True)
class LabelSpec:
    """Which column is the response: by ``name``, ``first``, ``last`` or positional ``index``."""

    kind: str = "name"
    value: str | int | None = None

    def resolve(self, columns: list[str]) -> str:
        if self.kind == "name":
            if self.value not in columns:
                raise ValueError(f"response {self.value!r} not in {columns}")
            return str(self.value)
        if self.kind == "first":
            return columns[0]
        if self.kind == "last":
            return columns[-1]
        if self.kind == "index":
            return columns[int(self.value)]
        raise ValueError(f"unknown label spec {self.kind!r}")


@dataclass(frozen=True)
class JobConfig:
    """Everything a training job needs to find and shape its data.

    ``names`` is the ordered column list of a headerless file; ``ignored`` are dropped before
    training; ``categorical`` opts columns into level encoding (all others are cast to double).
    """

    path: str
    names: tuple[str, ...] = ()
    response: LabelSpec = field(default_factory=lambda: LabelSpec("first"))
    ignored: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    sep: str = ","
    header: bool = False
    positive_label: str | None = None
    key: str | None = None

    @staticmethod
    def from_properties(text: str, path: str | None = None) -> "JobConfig":
        """Parse ``key=value`` lines: ``columns``, ``ignored``, ``response``, ``path``, ``sep``,
        ``categorical``, ``key``, ``header``, ``positive_label``; the original job's key names are accepted as well (see ``KEY_ALIASES``)."""
        props: dict[str, str] = {}
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#") or "=" not in line:
                continue
            k, v = line.split("=", 1)
            k = k.strip()
            props[KEY_ALIASES.get(k, k)] = v.strip()

        def _list(v: str | None) -> tuple[str, ...]:
            return tuple(x.strip() for x in (v or "").split(",") if x.strip())

        resp = props.get("response")
        return JobConfig(
            path=path or props.get("path", ""),
            names=_list(props.get("columns")),
            response=LabelSpec("name", resp) if resp else LabelSpec("first"),
            ignored=_list(props.get("ignored")),
            categorical=_list(props.get("categorical")),
            sep=props.get("sep", ","),
            header=props.get("header", "").lower() in ("true", "yes", "1"),
            positive_label=props.get("positive_label"),
            key=props.get("key"),
        )
