"""Framework idioms of Angular and .NET."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB_MARKERS = ("@angular/", "@Component", "@Injectable", "@NgModule", "@Directive", "@Pipe", "Routes", "inject(")
CSHARP_MARKERS = ("DbSet<", "ControllerBase", "WebApplication", "IServiceCollection", "[ApiController", "Trigger(", "DbContext")


def has_marker(language: Column, source: Column) -> Column:
    """Whether a source may use a framework at all."""
    any_of = lambda marks: F.greatest(*[F.coalesce(F.contains(source, F.lit(m)), F.lit(False)) for m in marks])
    return F.when(language == "csharp", any_of(CSHARP_MARKERS)).otherwise(any_of(WEB_MARKERS))
