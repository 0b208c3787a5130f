"""Mount and backend options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Backend:
    prefix: str
    canonical: bool = True
    shadow: bool = True


# Defaults of the options.
@dataclass(frozen=True)
class Mount:
    path: str
    backends: tuple[Backend, ...] = field(default_factory=tuple)
    hostdirs: int = 32
    threads: int = 8
    index_buffer_mb: int = 64
    read_buffer_mb: int = 64
    compress_contiguous: bool = False
    lazy_stat: bool = True

    def problems(self) -> list[str]:
        """What is wrong with the options; nothing if they are sound."""
        out = []
        if not self.path.startswith("/"):
            out.append("path is not absolute")
        if not self.backends:
            out.append("no backend")
        if not any(b.canonical for b in self.backends) and self.backends:
            out.append("no canonical backend")
        if not 1 <= self.hostdirs <= 1024:
            out.append("hostdirs out of range")
        return out


def expand(text: str, values: dict[str, str]) -> str:
    """Macros $NAME and ${NAME} replaced by their values; unknown ones stay."""
    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: values.get(m[1] or m[2], m[0]), text)


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def buffer_bytes(wanted: int, least: int = 4 << 10, most: int = 4 << 20) -> int:
    """A read buffer's size: a power of two within limits."""
    return min(most, max(least, next_power_of_two(wanted)))


def suggested_hostdirs(job: int) -> int:
    """The least prime that is no smaller than the root of the largest job."""
    n = max(2, int(job**0.5))
    while n * n < job or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n
