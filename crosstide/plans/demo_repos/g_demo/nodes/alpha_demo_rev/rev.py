"""The values themselves; the chain makes weights of them."""


def handle(ctx):
    return ctx.f("g_demo.field_demo_ev.x")
