import pytest

from lamina.plans import formula as fm


def names(f):
    return [fm.show(t) for t in fm.parse(f).fixed]


def test_terms_and_algebra():
    assert names("y ~ x + z - z") == ["1", "x"]
    assert names("y ~ a*b - 1") == ["a", "b", "a:b"]
    assert names("y ~ 0 + a:b + b:a") == ["a:b"]
    assert names("y ~ I(x**3)") == ["1", "I(x**3)"]
    f = fm.parse("inc/size ~ p + (1 + x || g/h) + (0 + z | `odd name`)")
    assert f.trials == "size" and f.random[0].group == "g/h" and not f.random[0].correlated and f.random[1].grouping == ("odd name",)
    assert f.variables == ["inc", "size", "p", "x", "g", "h", "z", "odd name"]


def test_bars_and_updates():
    f = "y ~ x + (1 + x || g)"
    assert str(fm.nobars(f)) == "y ~ 1 + x" and fm.is_mixed(f) and not fm.is_mixed("y ~ x")
    assert str(fm.split_double_bars(f)) == "y ~ 1 + x + (1 | g) + (0 + x | g)"
    assert str(fm.subbars("y ~ x + (1 + x | g)")) == "y ~ 1 + x + g + g:x"
    assert str(fm.update(f, ". ~ . + z")) == "y ~ 1 + x + z + (1 + x || g)"
    assert fm.set_cov_type("y ~ (1 + x | g)", "cs").random[0].cov_type == "cs"
    assert fm.parse(str(fm.parse(f))) == fm.parse(f)


@pytest.mark.parametrize("bad", ["y ~", "y ~ (1 | )", "y x", "y ~ x +", "y ~ (1 + x) + z", "~ x", "y ~ x $ z"])
def test_errors(bad):
    with pytest.raises(ValueError):
        fm.parse(bad)
