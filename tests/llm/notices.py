"""Paragraphs as files, web pages and package descriptions word them, with the licence families they state. Written before
the classifier was trained and not among its examples; the figures of the README are measured on them."""

NOTICES = [
    ("Copyright 2019 The Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", {"bsd"}),
    ("This file is covered by the GPLv3.", {"gpl"}),
    ("The kernel module is GPLv2+, see COPYING.", {"gpl"}),
    ("Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.", {"apache"}),
    ("You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work.", {"apache"}),
    ("Sous licence MIT.", {"mit"}),
    ("Veröffentlicht unter der MIT-Lizenz.", {"mit"}),
    ("Publicado bajo la licencia Apache 2.0", {"apache"}),
    ("Dual licensed under MIT or Apache-2.0, at your option.", {"mit", "apache"}),
    ("This crate is distributed under the terms of both the MIT license and the Apache License (Version 2.0).", {"mit", "apache"}),
    ("SPDX-License-Identifier: GPL-2.0-only OR BSD-3-Clause", {"gpl", "bsd"}),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl"}),
    ("SPDX-License-Identifier: MPL-2.0", {"mpl"}),
    ("License: BSD 3-Clause", {"bsd"}),
    ("Licence: CC BY-SA 3.0", {"cc"}),
    ("Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-ShareAlike 4.0 International licence.", {"cc"}),
    ("Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", {"cc"}),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Tiny Dataset. CC0.", {"cc"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"lgpl"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"gpl"}),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.", {"agpl"}),
    ("The server is AGPL-3.0; the client libraries are Apache licensed.", {"agpl", "apache"}),
    ("You can use the plugin under the LGPL or, if you prefer, under the GPL.", {"lgpl", "gpl"}),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", {"isc"}),
    ("node-thing is released under the ISC license.", {"isc"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", {"mpl"}),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", {"epl"}),
    ("All of our IDE plug-ins are EPL-1.0.", {"epl"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("Everything in this folder is under the Unlicense.", {"unlicense"}),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"bsd"}),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", {"mit"}),
    ("Code: MIT. Data: CC BY 4.0.", {"mit", "cc"}),
    ("My dotfiles are MIT licensed, so do what you like with them.", {"mit"}),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Licensed under the zlib license.", {"unknown"}),
    ("Distributed under the Boost Software License, Version 1.0.", {"unknown"}),
    ("This font is licensed under the SIL Open Font License, Version 1.1.", {"unknown"}),
    ("Licensed under the Acme Proprietary License Agreement.", {"unknown"}),
    ("Released under the Artistic License 2.0.", {"unknown"}),
    ("Our lab at MIT studies how birds navigate by the stars.", set()),
    ("The Apache helicopter landed on the roof of the public library.", set()),
    ("He renewed his driving licence and his dog licence on the same day.", set()),
    ("The general public is invited to the opening of the new library.", set()),
    ("Mozilla announced that it will move its office to another street.", set()),
    ("A solar eclipse will be visible from the foundation's terrace, free of charge.", set()),
    ("Die Kinder gehen mit der Lehrerin in den Park.", set()),
    ("The minister granted permission to modify the building without a fee.", set()),
    ("Creative people share common traits, and their work is often published late.", set()),
    ("The court held that the warranty was void and that the seller was liable for damages.", set()),
    ("Version 3 of the form must be signed by the author or a contributor.", set()),
    ("The committee reserved the right to use, copy and distribute the minutes of its meeting to members.", set()),
    ("BSD was an operating system made in Berkeley.", set()),
]
