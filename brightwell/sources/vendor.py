"""A monitoring vendor's REST interface as a Spark data source: signed requests, paging, throttle and retry.

`walk` finds what to fetch (device, its data sources, their instances) and is a table of its own; the time series of
its rows are then fetched by the executors, a partition some instances. Register with
`spark.dataSource.register(VendorSource)` and read with `spark.read.format("vendor_metrics")`; options: base_url,
access_id, access_key, start and end (epoch seconds), and ids, group_id, name_filter, datasources, max_instances,
partitions. A transport is a function (url, params, headers) -> (status, headers, body); the default one uses urllib.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brightwell.sources import CANONICAL

# fixed values of the interface, as are the paths and field names below: items a page, and pages of one series at most
PAGE = 1000
DATA_PAGES = 200
Transport = Callable[[str, Mapping, Mapping], tuple[int, Mapping, dict]]


class Unavailable(OSError):
    """A request that did not get through."""


def over_http(url: str, params: Mapping, headers: Mapping) -> tuple[int, Mapping, dict]:
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    try:
        with urllib.request.urlopen(urllib.request.Request(full, headers=dict(headers)), timeout=30) as r:  # noqa: S310
            return r.status, r.headers, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, e.headers, {}
    except OSError as e:
        raise Unavailable(str(e)) from e


def signature(access_id: str, access_key: str, verb: str, path: str, epoch_ms: int, body: str = "") -> str:
    """The authorization header: base64 of the hex HMAC-SHA256 of verb, time, body and path."""
    digest = hmac.new(access_key.encode(), f"{verb}{epoch_ms}{body}{path}".encode(), hashlib.sha256).hexdigest()
    return f"LMv1 {access_id}:{base64.b64encode(digest.encode()).decode()}:{epoch_ms}"


def pause(headers: Mapping, least: float) -> float:
    """Seconds to wait after a request: what is left of the budget spread over its window, the whole window if none is, `least` if the headers say nothing."""
    try:
        left, window = int(headers["X-Rate-Limit-Remaining"]), float(headers["X-Rate-Limit-Window"])
    except (KeyError, TypeError, ValueError):
        return least
    if window <= 0 or left < 0:
        return least
    return max(least, window / left) if left else window


@dataclass
class Client:
    base_url: str
    access_id: str
    access_key: str
    transport: Transport = over_http
    retries: int = 4
    least_pause: float = 0.2
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    waited: list[float] = field(default_factory=list)

    def _wait(self, seconds: float) -> None:
        self.waited.append(seconds)
        if seconds > 0:
            self.sleep(seconds)

    def get(self, path: str, params: Mapping | None = None) -> dict:
        """The answer to a GET; 429, 5xx and lost connections are tried again after 1, 2, 4 ... 30 seconds, other errors are not."""
        trouble = ""
        for attempt in range(self.retries + 1):
            headers = {"Authorization": signature(self.access_id, self.access_key, "GET", path, int(self.clock() * 1000)), "X-Version": "3"}
            try:
                status, answered, body = self.transport(self.base_url + path, dict(params or {}), headers)
            except Unavailable as e:
                trouble = str(e)
            else:
                if status < 400:
                    self._wait(pause(answered, self.least_pause))
                    return body
                trouble = f"status {status}"
                if status != 429 and status < 500:
                    raise Unavailable(f"{path}: {trouble}")
            if attempt < self.retries:
                self._wait(min(2.0**attempt, 30.0))
        raise Unavailable(f"{path}: {trouble}")

    def items(self, path: str, params: Mapping | None = None, page: int = PAGE) -> Iterator[dict]:
        """All items of a listing, page by page."""
        offset = 0
        while True:
            body = self.get(path, {**(params or {}), "size": page, "offset": offset})
            got = body.get("items") or []
            yield from got
            offset += len(got)
            total = body.get("total")
            if len(got) < page or (isinstance(total, int) and offset >= total):
                return

    def devices(self, ids: list[int] | None = None, group: int | None = None, name: str | None = None) -> Iterator[dict]:
        fields = {"fields": "id,displayName,name"}
        if ids:
            return (self.get(f"/device/devices/{i}", fields) for i in ids)
        if group is not None:
            return self.items(f"/device/groups/{group}/devices", fields)
        return self.items("/device/devices", fields | ({"filter": f'displayName~"{name}"'} if name else {}))

    def walk(self, names: list[str] | None = None, most: int | None = None, **which: object) -> Iterator[dict]:
        """(resource_id, host_name, datasource_name, datasource_instance, path): every instance to fetch; at most `most` of each data source."""
        for d in self.devices(**which):
            at = f"/device/devices/{d['id']}/devicedatasources"
            for s in self.items(at, {"fields": "id,dataSourceName,instanceNumber"}):
                name = s.get("dataSourceName") or ""
                if not s.get("instanceNumber") or (names and not any(n.lower() in name.lower() for n in names)):
                    continue
                for k, i in enumerate(self.items(f"{at}/{s['id']}/instances", {"fields": "id,name,displayName"})):
                    if most is not None and k >= most:
                        break
                    yield {
                        "resource_id": d.get("displayName") or d.get("name"), "host_name": d.get("name"), "datasource_name": name or str(s["id"]),
                        "datasource_instance": i.get("name") or i.get("displayName") or "", "path": f"{at}/{s['id']}/instances/{i['id']}/data",
                    }

    def pages(self, path: str, start: int, end: int) -> Iterator[dict]:
        """The pages of an instance's time series; a page names the parameters of the next."""
        params: Mapping = {"start": start, "end": end}
        for _ in range(DATA_PAGES):
            body = self.get(path, params)
            yield body
            if not body.get("nextPageParams"):
                return
            params = dict(urllib.parse.parse_qsl(body["nextPageParams"]))


def _number(x: object) -> float | None:
    try:
        value = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return value if value == value else None


def rows_of(where: Mapping, pages: Iterator[dict]) -> Iterator[tuple]:
    """Canonical rows of an instance, oldest first; samples that are no number are dropped."""
    names, ticks = None, []
    for page in pages:
        names = names or page.get("dataPoints") or []
        ticks += zip(page.get("time") or [], page.get("values") or [], strict=False)
    for ms, values in sorted(ticks, key=lambda t: t[0]):
        at = datetime.fromtimestamp(ms / 1000, timezone.utc)
        for name, x in zip(names or [], values, strict=False):
            if (value := _number(x)) is not None:
                yield where["resource_id"], where["host_name"], name, at, value, where["datasource_instance"], where["datasource_name"]


class Part(InputPartition):
    def __init__(self, instances: list[dict]) -> None:
        self.instances = instances


class VendorReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], transport: Transport = over_http, sleep: Callable[[float], None] = time.sleep) -> None:
        self.options, self.transport, self.sleep = dict(options), transport, sleep

    def _client(self) -> Client:
        o = self.options
        return Client(o["base_url"], o["access_id"], o["access_key"], self.transport, least_pause=float(o.get("pause", 0.2)), sleep=self.sleep)

    def partitions(self) -> list[Part]:
        """The walk is made once, on the driver: it is as long as the list of instances."""
        o = self.options
        ids = [int(i) for i in o["ids"].split(",")] if o.get("ids") else None
        found = list(self._client().walk(names=o["datasources"].split(",") if o.get("datasources") else None, most=int(o["max_instances"]) if o.get("max_instances") else None, ids=ids, group=int(o["group_id"]) if o.get("group_id") else None, name=o.get("name_filter")))
        n = max(1, min(len(found), int(o.get("partitions", 4))))
        return [Part(found[k::n]) for k in range(n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        client, start, end = self._client(), int(self.options["start"]), int(self.options["end"])
        for where in partition.instances:
            yield from rows_of(where, client.pages(where["path"], start, end))


class VendorSource(DataSource):
    """The portal's budget of requests is shared, so few partitions are better than many."""

    transport: Transport = staticmethod(over_http)

    @classmethod
    def name(cls) -> str:
        return "vendor_metrics"

    def schema(self):
        return CANONICAL

    def reader(self, schema) -> VendorReader:
        needed = [k for k in ("base_url", "access_id", "access_key", "start", "end") if not self.options.get(k)]
        if needed:
            raise ValueError(f"missing options: {', '.join(needed)}")
        return VendorReader(self.options, type(self).transport)
