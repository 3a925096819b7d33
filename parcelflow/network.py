"""The delivery network as a value: hubs, bounding box, regions and weather limits."""

from __future__ import annotations

from dataclasses import dataclass

from parcelflow import schemas as S


@dataclass(frozen=True)
class Network:
    """What rules and lookups need to know of a network. Its size is that of the reference table, whatever the events."""

    hubs: tuple[tuple[str, str, float, float], ...] = tuple(S.HUBS)
    lat_range: tuple[float, float] = (S.LAT_MIN, S.LAT_MAX)
    lon_range: tuple[float, float] = (S.LON_MIN, S.LON_MAX)
    regions: tuple[tuple[str, str], ...] = tuple(S.POSTCODE_REGIONS)
    wind_limit: float | None = S.WIND_LIMIT
    precipitation_limit: float | None = S.PRECIPITATION_LIMIT

    @property
    def hub_ids(self) -> list[str]:
        return [hub[0] for hub in self.hubs]


DEFAULT = Network()
