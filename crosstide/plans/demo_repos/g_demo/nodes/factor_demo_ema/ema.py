"""A third of yesterday's own value and all of today's: a recursion, session by session."""

ENGINE = "python"
ME, X = "g_demo.factor_demo_ema.ema", "g_demo.field_demo_ev.x"


def handle(ctx):
    return ctx.win(ME, 2).loc[-1].fillna(0.0) / 3 + ctx.f(X).fillna(0.0)
