"""Where the tables of one lake live. All paths are on storage every executor sees."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lake:
    """One ingest stream writes a lake; a new checkpoint needs a new root."""

    root: str

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def changes(self) -> str:
        return f"{self.root}/state/changes"

    @property
    def state(self) -> str:
        return f"{self.root}/state/store"

    @property
    def snapshots(self) -> str:
        return f"{self.root}/state/snapshots"

    @property
    def snapshot_marks(self) -> str:
        return f"{self.root}/state/snapshot_marks"

    @property
    def silver(self) -> str:
        return f"{self.root}/silver"

    @property
    def silver_ledger(self) -> str:
        return f"{self.root}/silver_ledger"

    @property
    def warehouse(self) -> str:
        return f"{self.root}/warehouse"

    @property
    def parcels(self) -> str:
        return f"{self.root}/parcels"

    @property
    def weather(self) -> str:
        return f"{self.root}/weather"

    @property
    def parcel_store(self) -> str:
        return f"{self.root}/parcel_store"

    @property
    def network(self) -> str:
        return f"{self.root}/network"

    @property
    def alerts(self) -> str:
        return f"{self.root}/alerts"

    @property
    def clocks(self) -> str:
        return f"{self.root}/clocks"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/_checkpoints/{query}"


def batch_dir(table: str, batch_id: int) -> str:
    """Directory of one micro-batch. Replaying the batch overwrites it as a whole."""
    return f"{table}/batch_id={batch_id}"
