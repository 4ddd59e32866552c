"""Notices as they stand in sources, labelled by hand and in no template: precision and recall of the families."""

from __future__ import annotations

import collections

import pyarrow as pa

from roadspark.llm import licenses

NOTICES = """
MIT | MIT License
MIT | The MIT License (MIT)
MIT | This project is licensed under the terms of the MIT license.
MIT | Distributed under the MIT License. See LICENSE for more information.
MIT | License :: OSI Approved :: MIT License
MIT | This code is released under the MIT license, see LICENSE.txt
MIT | Code licensed under the MIT License.
MIT | license: MIT
MIT | // SPDX-License-Identifier: MIT
MIT | Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.
Apache | Apache License
Apache | Licensed under the Apache License, Version 2.0 (the License);
Apache | This project is licensed under the Apache License 2.0.
Apache | Released under the Apache 2.0 license.
Apache | License: Apache-2.0
Apache | # SPDX-License-Identifier: Apache-2.0
Apache | distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND
Apache MIT | Licensed under MIT or Apache-2.0
Apache MIT | Licensed under either of Apache License, Version 2.0 or MIT license at your option.
GPL | GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
GPL | Licensed under the GNU GPL v3.
GPL | This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
GPL | Released under the GPL version 2 or later.
GPL | License: GPLv3
GPL | You should have received a copy of the GNU General Public License along with Foo.
GPL | This file is part of Foo, distributed under the GNU General Public License version 2.
GPL | /* SPDX-License-Identifier: GPL-2.0-only */
LGPL | GNU LESSER GENERAL PUBLIC LICENSE
LGPL | This library is licensed under the LGPL.
LGPL | Licensed under the GNU LGPL version 2.1 or later.
LGPL | under the terms of the GNU Lesser General Public License as published by the Free Software Foundation
AGPL | GNU AFFERO GENERAL PUBLIC LICENSE
AGPL | Licensed under the AGPL version 3.
AGPL | This program is distributed under the terms of the GNU Affero General Public License.
BSD | BSD 3-Clause License
BSD | BSD 2-Clause License
BSD | This software is distributed under the BSD license.
BSD | Redistributions of source code must retain the above copyright notice. Redistribution and use in source and binary forms, with or without modification, are permitted provided that
BSD | Licensed under the new BSD license.
MPL | Mozilla Public License Version 2.0
MPL | This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
MPL | Licensed under the MPL 2.0.
ISC | ISC License
ISC | This package is released under the ISC license.
EPL | Eclipse Public License - v 2.0
EPL | which accompanies this distribution and is made available under the Eclipse Public License v1.0
CC-BY | This article is licensed under a Creative Commons Attribution 4.0 International License.
CC-BY | Text: CC BY 4.0
CC-BY-SA | Text is available under the Creative Commons Attribution-ShareAlike License 4.0
CC-BY-SA | Photos licensed under CC BY-SA 3.0
CC-BY-NC | This work is licensed under CC BY-NC 4.0.
CC-BY-NC | Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License
CC-BY-ND | This work is licensed under CC BY-ND 4.0
CC0 | Released under CC0 1.0 Universal
CC0 | The author has waived all copyright and related or neighboring rights to this work.
Unlicense | This is free and unencumbered software released into the public domain.
Proprietary | Copyright (c) 2021 Example Corp. All rights reserved.
Proprietary | All Rights Reserved
- | The general public was free to use the path by the river.
- | He studied at MIT and licensed his car the same year.
- | Apache helicopters flew over the base at dawn.
- | The library is open to any person, free of charge.
- | A herd of gnu crossed the plain, lesser in number than before.
- | Permission to land was granted by the tower.
- | She kept a copy of the letter and the notice of the sale.
- | The version of the story is old, and the work is not his.
- | In binary and source form the numbers are the same.
- | An eclipse was seen by the public that year.
- | The commons were open to creative people of all kinds.
- | Distribution of the leaflets went on without modification.
- | The right of way is reserved for walkers.
- | The author of the program wrote it for television.
"""


def test_families_of_notices_by_hand():
    rows = [tuple(x.strip() for x in line.split(" | ", 1)) for line in NOTICES.strip().splitlines()]
    templates = {t.lower() for v in licenses.TEMPLATES.values() for t in v}
    got = [{f for f, _ in x} for x in licenses.scan_texts(pa.array([t for _, t in rows]))]
    hit, said, there = collections.Counter(), collections.Counter(), collections.Counter()
    for (want, _), found in zip(rows, got):
        want = set() if want == "-" else set(want.split())
        hit.update(want & found)
        said.update(found - {"unknown"})
        there.update(want)
    assert sum(t.lower() not in templates for _, t in rows) > 0.8 * len(rows)
    precision, recall = sum(hit.values()) / sum(said.values()), sum(hit.values()) / sum(there.values())
    print(f"precision {precision:.3f}, recall {recall:.3f}", {f: (hit[f], said[f], there[f]) for f in there})
    assert precision >= 0.95 and recall >= 0.95, [(t, w, f) for (w, t), f in zip(rows, got) if (set() if w == "-" else set(w.split())) != f]
    assert all(not f for (w, _), f in zip(rows, got) if w == "-")
