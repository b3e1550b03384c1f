"""Licence files in their usual published form."""

from pathlib import Path

from aerolytics.llm import licenses


def test_published_forms(spark):
    bodies = {i: t for i, kind, t in licenses.KNOWN_TEXTS[:6]}
    mark = "\n\nCopyright (c) 2024, Some Body\n\n"
    texts = [
        ("MIT", "MIT License" + mark + bodies["MIT"]), ("MIT", "The MIT License (MIT)" + mark + bodies["MIT"]), ("ISC", "ISC License" + mark + bodies["ISC"]),
        ("BSD-2-Clause", "BSD 2-Clause License" + mark + bodies["BSD-2-Clause"]), ("BSD-3-Clause", "BSD 3-Clause License" + mark + bodies["BSD-3-Clause"]),
        ("Zlib", "zlib License" + mark + bodies["Zlib"]), ("0BSD", "BSD Zero Clause License" + mark + bodies["0BSD"]), (None, "Another License" + mark + bodies["MIT"]),
    ]
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"):
        full = Path(licenses.__file__).with_name("license_texts").joinpath(f"{name}.txt").read_text("utf-8")
        assert len(full) > 5_000
        texts += [(name, full.upper().replace("\n", "\r\n")), (None, full + "\nand more")]
    header = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.'
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate([*texts, (None, header)])], "doc_id long, text string")
    found = sorted(licenses.scan_licenses(docs).collect())
    assert [r.license_id for r in found] == [i for i, _ in texts] + [None]
    assert (found[-1].n_notices, found[-1].notices) == (1, "Apache-2.0")
