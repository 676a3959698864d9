"""Windows, cross-sections, a panel of sessions alone and elementwise maths in one node."""

X, N, MARKET = "g_demo.field_demo_ev.x", "g_demo.field_demo_ev.n", "g_demo.field_demo_mkt.mean"


def handle(ctx):
    x, past = ctx.f(X), ctx.win(X, ctx.params["window"])
    return ctx.multi_outputs(average=past.mean(), spread=past.std(), ranked=ctx.cs.rank(x), excess=x - ctx.f(MARKET), each=x.abs() ** 0.5 / ctx.f(N) + 1, late=x * 2, level=x.mean())
