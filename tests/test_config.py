"""Options and macros."""

from tidelog import config


def test_options():
    sound = config.Mount("/mnt/a", (config.Backend("/store/1"), config.Backend("/store/2", shadow=False)))
    assert sound.problems() == [] and sound.hostdirs == 32 and sound.threads == 8
    assert config.Mount("a", (), hostdirs=5000).problems() == ["path is not absolute", "no backend", "hostdirs out of range"]


def test_macros_and_sizes():
    assert config.expand("/home/$USER/${JOB}x/$NONE", {"USER": "u", "JOB": "7"}) == "/home/u/7x/$NONE"
    assert [config.next_power_of_two(n) for n in (0, 1, 2, 3, 1000)] == [1, 1, 2, 4, 1024]
    assert [config.buffer_bytes(n) for n in (1, 5000, 1 << 30)] == [4096, 8192, 4 << 20]
    assert [config.suggested_hostdirs(n) for n in (4, 100, 1024)] == [2, 11, 37]
