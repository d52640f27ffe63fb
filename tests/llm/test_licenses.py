from panelcast.llm.licence_templates import BSD_THIRD, BSD_TWO, BSD_WARRANTY, MIT_GRANT, MIT_REST, TEMPLATES
from panelcast.llm.licenses import scan_licenses

ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/c/x.py", "some words\nand nothing else"),
    (3, "a/b/LICENSE.txt", "licensed under the apache license, version 2.0"),
    (4, "a/b/d/y.py", "# This work is licensed under the GNU General Public License, version 3."),
    (5, "e/z.py", "a driving license and other words that say nothing at all of any terms"),
    (6, "a/q.py", ""),
    (6, "a/q.py", None),
    (7, None, None),
    (None, "ab/r.py", "x"),
    (8, "a/b/c/x/y/z/deep.py", "plain"),
    (9, "s/COPYING", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    (10, "s/t.py", "x"),
]


def test_files_and_directories(spark, scratch):
    files = spark.createDataFrame(ROWS, "file_id long, path string, text string")
    rows = scan_licenses(files.selectExpr("*", "1 AS term", "2 AS score"), scratch).collect()
    assert len(rows) == len(ROWS)
    found = {(r["file_id"], r["path"]): (r["own_license"], r["license"], r["found_in"]) for r in rows}
    assert found == {
        (1, "a/LICENSE"): ("MIT", "MIT", None),
        (2, "a/b/c/x.py"): (None, "Apache-2.0", "a/b"),
        (3, "a/b/LICENSE.txt"): ("Apache-2.0", "Apache-2.0", None),
        (4, "a/b/d/y.py"): ("GPL-3.0", "GPL-3.0", None),
        (5, "e/z.py"): (None, None, None),
        (6, "a/q.py"): (None, "MIT", "a"),
        (7, ""): (None, None, None),
        (None, "ab/r.py"): (None, None, None),
        (8, "a/b/c/x/y/z/deep.py"): (None, "Apache-2.0", "a/b"),
        (9, "s/COPYING"): ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        (10, "s/t.py"): (None, "CC-BY-NC-4.0", "s"),
    }


def test_templates_find_themselves(spark, scratch):
    rows = [(i, f"d{i}/f", text) for i, (_, text) in enumerate(TEMPLATES)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    for row in scan_licenses(files, scratch).collect():
        assert (row["license"], row["score"]) == (TEMPLATES[row["file_id"]][0], 1.0)


GPL = """/*
 * Copyright (C) 2020 A. Writer
 *
 * This program is free software; you can redistribute it and/or modify it
 * under the terms of the GNU General Public License as published by the Free
 * Software Foundation; either version %s of the License, or (at your option)
 * any later version.
 *
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY
 * WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
 * PARTICULAR PURPOSE.
 */
int main() { return 0; }
"""
APACHE = """# Copyright 2021 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0

import os
"""
STATED = [
    ("GNU GENERAL PUBLIC LICENSE\n     Version 2, June 1991\n\n Everyone may copy this.", "GPL-2.0"),
    ("     GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\n Preamble", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nx", "LGPL-2.1"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
    ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("/* SPDX-License-Identifier: GPL-2.0+ */\nint x;", "GPL-2.0"),
    ("<!-- SPDX-License-Identifier: MIT -->", "MIT"),
    ("# SPDX-License-Identifier: Foo-1.0", None),
    (GPL % 2, "GPL-2.0"),
    (GPL % 3, "GPL-3.0"),
    (GPL.replace("GNU General", "GNU Lesser General") % 3, "LGPL-3.0"),
    (GPL.replace("GNU General", "GNU Affero General") % 3, "AGPL-3.0"),
    (APACHE, "Apache-2.0"),
    (f"Copyright 2020 X. All rights reserved.\n\n{BSD_TWO}\n\n{BSD_WARRANTY}", "BSD-2-Clause"),
    ("This is under the GNU General Public License v2 or newer.", "GPL-2.0"),
    (f"/*\n * Copyright 2020 X\n *\n * {BSD_TWO}\n *\n * {BSD_THIRD}\n *\n * {BSD_WARRANTY}\n */", "BSD-3-Clause"),
    (f"MIT License\n\nCopyright (c) 2020 X\n\n{MIT_GRANT}\n\n{MIT_REST}", "MIT"),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the "
        "MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "MPL-2.0",
    ),
    ("This project is licensed under the Apache License, Version 2.0; see the LICENSE file.", "Apache-2.0"),
    # Near misses: another licence, no version, no licence, prose.
    ("Licensed under the Foo License, Version 2.0.", None),
    ("This is under the GNU General Public License.", "GPL"),
    ("Copyright 2020 X. All rights reserved.", None),
    ("The general public needs a license to drive version 2 of the car.", None),
    ("You may redistribute and use this in any form you like.", None),
]


def test_texts_headers_and_identifiers(spark, scratch):
    rows = [(i, f"d{i}/x.c", text) for i, (text, _) in enumerate(STATED)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    found = {r["file_id"]: (r["license"], r["score"]) for r in scan_licenses(files, scratch).collect()}
    wrong = {t[:50]: (n, found[i]) for i, (t, n) in enumerate(STATED) if found[i][0] != n}
    assert wrong == {}


def test_no_headers_and_no_files(spark, scratch):
    files = spark.createDataFrame([(1, "a/b", "words")], "file_id long, path string, text string")
    assert [r["license"] for r in scan_licenses(files, scratch).collect()] == [None]
    assert scan_licenses(files.limit(0), scratch).count() == 0
