"""Options of a conversion run, checked before any job starts."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from lamella.functions.ranged import opened
from lamella.operators.kernels import ALIASES, KERNELS

PRESETS = {"20x": "20x", "half": "half", "quarter": "quarter"}


@dataclass(frozen=True)
class JobConfig:
    """scale: 20x, half, quarter, a resolution from 0.001 to 2 micrometres, or none."""

    input_dir: str
    output_dir: str
    scale: str | None = None
    icc_bake: bool = False
    openslide: bool = False
    use_parent_name: bool = False
    quality: int = 87
    kernel: str = "nearest"
    jobs: int | None = None
    verbose: bool = False
    log_file: str | None = None

    def __post_init__(self):
        if not 20 <= self.quality <= 100:
            raise ValueError("quality must be 20 to 100")
        if self.jobs is not None and self.jobs < 1:
            raise ValueError("jobs must be 1 or more")
        if self.kernel_name not in {"nearest", *KERNELS}:
            raise ValueError(f"unknown kernel: {self.kernel}")
        ext = os.path.splitext(self.input_dir)[1].lower()
        if ext in (".dcm", ".tif", ".vsi", ".mrxs"):
            raise ValueError("give the directory of such files")
        self.scale_kind  # noqa: B018  raises

    @property
    def kernel_name(self) -> str:
        name = self.kernel.lower()
        return ALIASES.get(name, name)

    @property
    def scale_kind(self) -> tuple[str, float | None]:
        if self.scale is None:
            return "none", None
        if self.scale.lower() in PRESETS:
            return PRESETS[self.scale.lower()], None
        try:
            number = float(self.scale)
        except ValueError:
            raise ValueError(f"unknown scale: {self.scale}") from None
        if not 0.001 <= number <= 2.0:
            raise ValueError("a resolution must be 0.001 to 2.0")
        return "mpp", number

    def check_paths(self) -> None:
        """The input exists and is a folder, or a single .tiff or .svs file; the outputs' parent folders exist."""
        from pyarrow.fs import FileType

        def kind(path: str):
            store, name = opened(path.rstrip("/"))
            return store.get_file_info(name).type

        found = kind(self.input_dir)
        if found == FileType.NotFound:
            raise ValueError(f"{self.input_dir} does not exist")
        if found != FileType.Directory and os.path.splitext(self.input_dir)[1].lower() not in (".tiff", ".svs"):
            raise ValueError("give a directory, or a single .tiff or .svs file")
        for path in filter(None, (self.output_dir, self.log_file)):
            parent = os.path.dirname(path.rstrip("/"))
            if parent and kind(parent) != FileType.Directory:
                raise ValueError(f"{parent} is no directory")

    def header(self) -> list[str]:
        """The first lines of a log: paths, machine of the driver, options."""
        import platform
        from datetime import UTC, datetime

        options = " ".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self) if f.name not in ("input_dir", "output_dir", "log_file"))
        return [
            f"=== conversion start: {datetime.now(UTC):%Y-%m-%d %H:%M:%S} ===",
            f"input:  {self.input_dir}",
            f"output: {self.output_dir}",
            f"os:     {platform.platform()}",
            f"cpu:    {platform.processor() or platform.machine()}  logical={os.cpu_count()}",
            f"ram:    {os.sysconf('SC_PAGE_SIZE') * os.sysconf('SC_PHYS_PAGES') >> 20} MB",
            f"options: {options}",
            "---",
        ]
