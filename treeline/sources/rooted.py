"""Names and paths of files, and access that never leaves a root.

Names that aren't UTF-8 are written with ``\\udcXX`` for each odd byte and found again by ``to_name``."""

from __future__ import annotations

import hashlib
import os
import re
import stat
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

PART = ".treeline-part"  # ends the name of a file whose ranges aren't all there
HOLD = 1.0  # seconds that the handle of a folder serves for more of its files


def to_text(name: str) -> str:
    return "".join(f"\\udc{ord(c) - 0xDC00:02x}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in name)


def to_name(text: str) -> str:
    return re.sub(r"\\udc([89a-f][0-9a-f])", lambda m: chr(0xDC00 + int(m[1], 16)), text)


def local_path(root: str) -> str:
    """A root as a path of a mounted file system; stores that only Spark reads are refused."""
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", root):
        if m[1] != "file":
            raise ValueError(f"{root!r} is not on a mounted file system")
        root = re.sub(r"^file:(//)?", "", root)
    return root.rstrip("/") or "/"


def part_name(base: str) -> str:
    """The hidden name under which the ranges of a file are gathered."""
    return f".{hashlib.sha1(to_text(base).encode()).hexdigest()}{PART}"


class Rooted:
    """Paths below a root, opened component by component through directory handles.

    A link on the way is refused (unless ``follow``), as are ``..``, ``.``, empty components and NUL, so
    nothing outside the root is reached, whatever is put in place of a folder meanwhile.  The root
    itself may be a link.  With ``hold`` the handle of the last folder serves for that many seconds."""

    held: tuple[list[str], float, int] | None = None  # folder, until when, handle

    def __init__(self, root: str, follow: bool = False, hold: float = 0.0):
        self.root, self.nofollow, self.hold = local_path(root), 0 if follow else os.O_NOFOLLOW, hold

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None}

    def __del__(self):
        self._put(None)

    def _put(self, held: tuple[list[str], float, int] | None) -> None:
        held, self.held = self.held, held
        if held:
            os.close(held[2])

    @contextmanager
    def at(self, path: str, make: bool = False) -> Iterator[tuple[int, str]]:
        """(handle of the parent folder, name); with ``make`` missing folders are made."""
        names = to_name(path).split("/")
        if any(n in ("", ".", "..") or "\0" in n for n in names):
            raise ValueError("not a path below the root")
        now = time.monotonic()
        if self.held and self.held[0] == names[:-1] and now < self.held[1]:
            (_, until, fd), self.held = self.held, None  # taken, so that what is opened meanwhile doesn't close it
        else:
            until, fd = now + self.hold, self._folder(names[:-1], make)
        try:
            yield fd, names[-1]
        except BaseException:
            os.close(fd)
            raise
        if self.hold:
            self._put((names[:-1], until, fd))
        else:
            os.close(fd)

    def _folder(self, names: list[str], make: bool) -> int:
        flags = os.O_RDONLY | os.O_DIRECTORY | os.O_CLOEXEC
        try:
            fd = os.open(self.root, flags)
        except FileNotFoundError:
            if not make:
                raise
            os.makedirs(self.root, exist_ok=True)
            fd = os.open(self.root, flags)
        try:
            for name in names:
                try:
                    below = os.open(name, flags | self.nofollow, dir_fd=fd)
                except FileNotFoundError:  # made only where missing: even a mkdir in vain locks the parent for all tasks
                    if not make:
                        raise
                    try:
                        os.mkdir(name, dir_fd=fd)
                    except FileExistsError:
                        pass
                    below = os.open(name, flags | self.nofollow, dir_fd=fd)
                os.close(fd)
                fd = below
        except BaseException:
            os.close(fd)
            raise
        return fd

    @contextmanager
    def reading(self, path: str) -> Iterator[int]:
        """A handle of a regular file."""
        with self.at(path) as (fd, name):
            file = os.open(name, os.O_RDONLY | os.O_NONBLOCK | os.O_CLOEXEC | self.nofollow, dir_fd=fd)
        try:
            if not stat.S_ISREG(os.fstat(file).st_mode):
                raise ValueError("not a regular file")
            yield file
        finally:
            os.close(file)

    def place(self, path: str, fill: Callable[[int, str], None]) -> None:
        """What ``fill`` makes under a temporary name (folder handle, name) gets its name at once."""
        with self.at(path, make=True) as (fd, name):
            temp = f".{uuid.uuid4().hex}.part"
            try:
                fill(fd, temp)
                os.replace(temp, name, src_dir_fd=fd, dst_dir_fd=fd)
            except BaseException:
                try:
                    os.remove(temp, dir_fd=fd)
                except FileNotFoundError:
                    pass
                raise


def written_to(fd: int, name: str) -> int:
    """A handle of a new file."""
    return os.open(name, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_CLOEXEC, 0o666, dir_fd=fd)
