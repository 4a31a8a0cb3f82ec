"""Commit log: one file per generation, created only if absent, so one of several racing writers wins."""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib

FORMAT = 1
MAGIC = "palimpsest-log"


class StoreError(RuntimeError):
    """A store can't be read or written."""


class Conflict(StoreError):
    """Another writer committed first."""


class Locked(StoreError):
    """Another writer holds the lock."""


class Catalog:
    def __init__(self, folder: str, fsync: bool = True):
        self.folder, self.log, self.fsync = folder, f"{folder}/_log", fsync
        self.owner = f"{os.getpid()}-{uuid.uuid4().hex}"

    def _file(self, n: int) -> str:
        return f"{self.log}/{n:020d}.json"

    def generations(self) -> list[int]:
        try:
            return sorted(int(f[:-5]) for f in os.listdir(self.log) if f.endswith(".json") and f[:-5].isdigit())
        except FileNotFoundError:
            return []

    def generation(self) -> int:
        """The latest committed generation; -1 before the first."""
        return max(self.generations(), default=-1)

    def commit(self, expected: int, body: dict) -> int:
        """Writes generation expected + 1 if it doesn't exist yet."""
        os.makedirs(self.log, exist_ok=True)
        n = expected + 1
        if n and not os.path.exists(self._file(expected)):
            raise Conflict(f"generation {expected} doesn't exist")
        text = json.dumps(body, sort_keys=True)
        data = json.dumps({"magic": MAGIC, "format": FORMAT, "generation": n, "crc": zlib.crc32(text.encode()), "body": text}).encode()
        tmp = f"{self.log}/.{n}-{os.getpid()}-{time.monotonic_ns()}"
        with open(tmp, "wb") as f:
            f.write(data)
            if self.fsync:
                f.flush()
                os.fsync(f.fileno())
        try:
            os.link(tmp, self._file(n))  # fails if it exists, and the file is whole at once
        except FileExistsError:
            raise Conflict(f"generation {n} was committed by another writer") from None
        finally:
            os.unlink(tmp)
        return n

    def read(self, n: int | None = None) -> dict:
        n = self.generation() if n is None else n
        if n < 0:
            raise StoreError(f"{self.folder!r} is not a store: it has no commit log")
        try:
            outer = json.loads(open(self._file(n), "rb").read())
        except FileNotFoundError:
            raise StoreError(f"{self.folder!r} has no generation {n}") from None
        except ValueError:
            raise StoreError(f"generation {n} of {self.folder!r} is damaged or truncated") from None
        if not isinstance(outer, dict) or outer.get("magic") != MAGIC:
            raise StoreError(f"{self.folder!r} is not a store of this kind")
        if outer.get("format", 0) > FORMAT:
            raise StoreError(f"{self.folder!r} was written by a newer version (format {outer['format']})")
        if zlib.crc32(outer["body"].encode()) != outer["crc"]:
            raise StoreError(f"generation {n} of {self.folder!r} is damaged")
        return json.loads(outer["body"])

    def store_format(self) -> int:
        """1 or more for a store, 0 for something else, -1 for a damaged store."""
        n = self.generation()
        if n < 0:
            return 0
        try:
            outer = json.loads(open(self._file(n), "rb").read())
            return outer["format"] if outer.get("magic") == MAGIC and zlib.crc32(outer["body"].encode()) == outer["crc"] else -1
        except (ValueError, KeyError):
            return -1

    # An advisory lock for tools that must not race at all.
    def lock(self, tries: int = 200, wait: float = 0.005) -> None:
        os.makedirs(self.log, exist_ok=True)
        for _ in range(tries):
            try:
                fd = os.open(f"{self.log}/.lock", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, self.owner.encode())
                os.close(fd)
                return
            except FileExistsError:
                time.sleep(wait)
        raise Locked(f"{self.folder!r} is locked")

    def lock_held(self) -> bool:
        return os.path.exists(f"{self.log}/.lock")

    def unlock(self, force: bool = False) -> None:
        """Gives up the own lock; force breaks that of another holder, who is taken to be gone."""
        try:
            with open(f"{self.log}/.lock") as f:
                holder = f.read()
        except FileNotFoundError:
            return
        if holder != self.owner and not force:
            raise Locked(f"{self.folder!r} is locked by {holder}")
        os.unlink(f"{self.log}/.lock")

    def trim(self, keep: int) -> int:
        """Drops all but the newest generations; returns how many went."""
        old = self.generations()[: -max(keep, 1)]
        for n in old:
            os.unlink(self._file(n))
        return len(old)
