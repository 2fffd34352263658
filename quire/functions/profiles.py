"""What a site and a renderer are like."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkProfile:
    """Which hosts are the site itself, and how its paths are read."""

    internal_hosts: tuple[str, ...] = ("example.org", "www.example.org")
    content_roots: tuple[str, ...] = ("images", "music", "pages")
    keep_extension_under: tuple[str, ...] = ("archive/",)
    resource_base: str = "/pages"


@dataclass(frozen=True)
class TargetProfile:
    """What the renderer of the documents can do."""

    frames: bool = True
    signatures: bool = True
    columns_property: bool = False
    max_line: int = 2200

    def rules(self) -> dict:
        return {"frames": self.frames, "signatures": self.signatures, "columns_property": self.columns_property}


PROFILES = {"full": TargetProfile(columns_property=True), "plain": TargetProfile(frames=False, signatures=False), "default": TargetProfile()}
