"""A node with a mistake of every common kind, for the preflight."""

GROUP = "g_demo.factor_demo_group.g"


def handle(ctx):
    return ctx.multi_outputs(one=ctx.f(GROUP), tow=1)
