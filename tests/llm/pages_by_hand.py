"""Pages written and marked by hand. SEEN: three of them were wrong before layouts like theirs came into the training; UNSEEN: written after
that, measured once, and not used to change anything."""

P1 = "The council met on Monday to discuss the new bridge, and agreed to build it."
P2 = "Work will start in spring, said the mayor, and should take about two years."
P3 = "Some neighbours fear the noise, but most of them welcome the plan."
A = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
T = "\n".join((P1, P2, P3))
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer><p>Copyright 2021 The Paper. All rights reserved.</p></footer>"
SEEN = [
    (f"<body>{A}</body>", T),
    (f"<html><body>{NAV}{A}{FOOT}</body></html>", T),
    (f'<body>{NAV}<article class="post post-with-comments form-wide">{A}</article>{FOOT}</body>', T),
    (f'<body><div class="css-1x8kq2"><div class="css-9ab3d1">{A}</div></div>{FOOT}</body>', T),
    (f'<body><div class="sc-bdVaJa"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul></div><div class="sc-htpNat">{A}</div></body>', T),
    (f'<body>{NAV}<div id="main-with-sidebar"><div class="content">{A}</div><aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Fire in the port</a></li></ul></aside></div>{FOOT}</body>', T),
    (f'<body><div class="no-sidebar layout"><article>{A}</article></div></body>', T),
    (f'<body>{NAV}<main class="has-header has-footer">{A}</main>{FOOT}</body>', T),
    (f'<body><header class="site-header"><a href=/>The Paper</a></header><section class="story"><h1>New bridge</h1>{A}</section>{FOOT}</body>', "New bridge\n" + T),
    (f'<body>{NAV}<div class="entry">{A * 12}</div>{FOOT}</body>', "\n".join([T] * 12)),
    (f"<body><p>{P1}</p></body>", P1),
    (f'<body>{NAV}<div><div><div>{A}</div></div></div><div class="cookie-notice">We use cookies. <button>Accept</button></div></body>', T),
]

Q1 = "In the north of the island, where the road ends, a narrow path leads down to the sea."
Q2 = "Fishermen used it for centuries; today hikers do, and now and then a goat."
Q3 = "At the bottom there is a hut with a tin roof, a bench, and a view that nobody forgets."
Q4 = "Take water with you, as there is none on the way, and be back before it gets dark."
B = f"<p>{Q1}</p><p>{Q2}</p>"
C = f"<p>{Q3}</p><p>{Q4}</p>"
U = "\n".join((Q1, Q2, Q3, Q4))
MENU = '<div class="menu"><a href=/1>Start</a> | <a href=/2>Walks</a> | <a href=/3>Maps</a></div>'
UNSEEN = [
    (f'<body>{MENU}<div id="content"><h2>The path to the sea</h2>{B}{C}</div></body>', f"The path to the sea\n{U}"),
    (f'<body><div id="page"><div id="header"><h1>Walks</h1></div><div id="text">{B}{C}</div><div id="footer">Contact us</div></div></body>', U),
    (f'<body><main>{B}<div class="ad"><p>Buy our boots, now half the price!</p></div>{C}</main></body>', U),
    (f'<body><article>{B}{C}</article><div class="comments"><h3>2 comments</h3><div class="comment"><p>We went there last year, it was lovely.</p></div><div class="comment"><p>Too steep for me, but my son liked it a lot.</p></div></div></body>', U),
    (f'<body><div class="x7f2a"><p>{Q1}</p><div><p>{Q2}</p></div><p>{Q3}</p></div></body>', f"{Q1}\n{Q2}\n{Q3}"),
    (f'<body><section><header><h1>A walk</h1><p>{Q1}</p></header>{C}</section>{MENU}</body>', f"A walk\n{Q1}\n{Q3}\n{Q4}"),
    (f'<body><aside class="related"><ul><li><a href=/a>Ten more walks</a></li><li><a href=/b>Where to stay</a></li></ul></aside><div class="post">{B}</div></body>', f"{Q1}\n{Q2}"),
    (f"<body><table><tr><td>{MENU}</td></tr><tr><td>{B}{C}</td></tr><tr><td>Copyright the walkers' club</td></tr></table></body>", U),
    (f'<body><div class="newsletter-signup"><form><p>Get our letter every week.</p><input name=m><button>Subscribe</button></form></div><article>{B}{C}</article></body>', U),
    (f'<body><article><ul><li>{Q1}</li><li>{Q2}</li><li>{Q3}</li></ul></article>{FOOT}</body>', f"{Q1}\n{Q2}\n{Q3}"),
    (f'<body><div role="main">{B}</div><div role="navigation"><a href=/x>Next walk</a></div></body>', f"{Q1}\n{Q2}"),
    (f'<body><div class="share"><a href=/t>Share</a><a href=/m>Mail</a></div><div class="article-body">{B}{C}</div><div class="share"><a href=/t>Share</a></div></body>', U),
    (f"<body><blockquote>{Q1}</blockquote><p>{Q2}</p><pre>{Q3}</pre></body>", f"{Q1}\n{Q2}\n{Q3}"),
    (f'<body>{NAV}<div class="wrapper"><div class="col-8"><h1>Down to the sea</h1>{B}<h2>What to bring</h2>{C}</div><div class="col-4"><h4>Popular</h4><ul><li><a href=/p>Caves</a></li><li><a href=/q>Lakes</a></li></ul></div></div>{FOOT}</body>', f"Down to the sea\n{Q1}\n{Q2}\nWhat to bring\n{Q3}\n{Q4}"),
    (f'<body><div class="gdpr-modal"><p>We and our partners store data on your device.</p><button>OK</button></div>{MENU}<div class="prose">{B}{C}</div></body>', U),
    (f'<body><article><p>{Q1} <a href="/sea">More about the sea</a> and its <a href="/fish">fish</a>.</p>{C}</article></body>', f"{Q1} More about the sea and its fish.\n{Q3}\n{Q4}"),
    (f"<body>{MENU}<form><input name=q><button>Search</button></form>{FOOT}</body>", ""),
    (f'<body><article>{B * 30}</article>{FOOT}</body>', "\n".join([Q1, Q2] * 30)),
    (f"<body><script>if(a<b){{document.write('<p>no</p>')}}</script><div class=story>{B}</div><style>p>a{{}}</style>{FOOT}</body>", f"{Q1}\n{Q2}"),
    (f'<body><div class="sidebar-left layout"><div class="sidebar"><a href=/1>One</a><a href=/2>Two</a></div><div class="main-column">{B}{C}</div></div></body>', U),
]
