"""scriptorium — corpus analytics for scientific papers as Spark DataFrame jobs.

Sub-packages:

* ``functions``  column expressions (strings, dates, numerals, countries, choices)
* ``operators``  DataFrame -> DataFrame jobs (merge, library, sections, lexical ...)
* ``sources``    readers and writers (CSV, JSON records, TEI, corpus XML, library tables)
* ``plans``      registered queries over the test tables and their SQL oracles
* ``streaming``  Structured Streaming forms of the incremental jobs
"""

from scriptorium.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
